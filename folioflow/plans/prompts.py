"""What models are told: a captioner, a renderer, a reviewer and a cleaner."""

from __future__ import annotations

_LANGUAGES = {"vi": "Vietnamese", "en": "English"}

_CAPTION = """You read one image of a document, with some of the text around it.

If the image is nothing but a grid whose cells are mostly numbers, write one or two sentences: what the numbers stand for, and
their main trend or comparison. Copy no cells.

Otherwise copy out all text that can be seen, word for word, in its own language, and keep its structure as Markdown:
- a chart: its kind, the names of axes and series, the values that can be read, the trend it shows;
- a diagram: its layout, every node, and every link as `A -> B` with its label;
- a screenshot: the parts of the window, their texts, the state shown;
- a photo or drawing: subject and setting.

Words of your own are written in {language}. Text of the image is never translated.
Say nothing that the image does not show. An image that is only ornament is answered with exactly `{ornament}`.
Answer with the text alone: no heading, no quotes, no code fence."""

_RENDER = """You turn the draft of one part of a document into clean Markdown. The draft holds all of the content, in reading order.

Keep every heading, paragraph, list item, table, code block, link and image marker, in the same order. Add nothing of your own.
Keep heading levels, bold, italic and code marks. Tables stay GFM tables. An image keeps its marker line and the caption under it.
Lists and hierarchies of a diagram are nested bullets; cycles, processes and flow charts are Mermaid.
Where the end of the part before is given, go on from it: repeat none of it and keep its list and heading levels.
Answer with the Markdown alone."""

_REVIEW = """You compare a rendered part of a document with its draft and mend small faults: content that is missing, twice or out of order, image
markers that are lost, tables or fences that are broken, heading levels that are skipped. Leave all else as it is.
Answer with the whole mended Markdown alone."""

_CLEAN = """You tidy a rendered part of a document and keep its content. A first part without a title gets one; heading levels are made regular; running
heads and feet, page numbers, captions of logos and other ornament go, as do adjectives that only praise.
Answer with the whole Markdown alone."""


def language_of(caption_language: str, primary_language: str) -> str:
    """The language of a model's own words, as it is put to it."""
    primary = _LANGUAGES.get(primary_language, primary_language)
    return f"the language of the text around the image, or {primary} where that is not clear" if caption_language == "auto" else _LANGUAGES.get(caption_language, caption_language)


def caption_prompt(caption_language: str = "auto", primary_language: str = "vi") -> str:
    own = caption_language if caption_language != "auto" else primary_language
    return _CAPTION.format(language=language_of(caption_language, primary_language), ornament="Hình trang trí" if own == "vi" else "Decorative image")


def render_steps(review: bool, clean: bool) -> list[tuple[str, str]]:
    """(name, prompt) of the calls that render one part: the draft's rendering, then what the two flags ask for."""
    return [("render", _RENDER)] + [("review", _REVIEW)] * review + [("clean", _CLEAN)] * clean
