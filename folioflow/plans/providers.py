"""Captioning and rendering by models: protocols, pacing, retries and fallbacks. Without a model everything stays offline."""

from __future__ import annotations

import base64
import functools
import json
import os
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.refs import NO_CAPTION
from .prompts import caption_prompt, render_steps

#: Characters of the chunk before that a renderer sees.
TAIL = 1000
#: What stands for an image whose bytes are missing, and for a drawing no vision model reads.
NOT_FOUND, NO_SVG = "[Image: not found]", "[SVG diagram: caption unavailable]"


class CaptionModel(Protocol):
    def caption(self, context: str, content: bytes) -> str: ...


class RenderModel(Protocol):
    def render(self, markdown: str, previous_tail: str) -> str: ...


@dataclass(frozen=True)
class ModelConfig:
    """A model behind an HTTP interface: ``provider`` is one of ``PROVIDERS``, or ``custom`` with an ``instance`` of one's own.

    The key is read from the environment variable ``api_key_env`` on the worker; it is never part of a plan.
    """

    provider: str = "openai"
    model: str = ""
    base_url: str | None = None
    api_key_env: str | None = None
    instance: object | None = None
    extra: tuple[tuple[str, object], ...] = ()
    timeout_seconds: int = 180


def _parts(text: str, image: bytes | None, one_image: Callable[[str], dict]) -> list[dict]:
    return [{"type": "text", "text": text}] + ([one_image(base64.b64encode(image).decode())] if image else [])


def _chat_completions(c: ModelConfig, key: str | None, system: str, text: str, image: bytes | None):
    shown = lambda b: {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{b}"}}
    body = {"model": c.model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": _parts(text, image, shown)}]}
    return "/chat/completions", {"Authorization": f"Bearer {key}"} if key else {}, body, lambda r: r["choices"][0]["message"]["content"]


def _serving_endpoint(c: ModelConfig, key: str | None, system: str, text: str, image: bytes | None):
    _, headers, body, read = _chat_completions(c, key, system, text, image)
    return f"/serving-endpoints/{c.model}/invocations", headers, {k: v for k, v in body.items() if k != "model"}, read


def _messages(c: ModelConfig, key: str | None, system: str, text: str, image: bytes | None):
    shown = lambda b: {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": b}}
    body = {"model": c.model, "temperature": 0, "max_tokens": 16_000, "system": system, "messages": [{"role": "user", "content": _parts(text, image, shown)}]}
    return "/v1/messages", {"x-api-key": key or "", "anthropic-version": "2023-06-01"}, body, lambda r: r["content"]


def _generate_content(c: ModelConfig, key: str | None, system: str, text: str, image: bytes | None):
    parts = [{"text": text}] + ([{"inline_data": {"mime_type": "image/png", "data": base64.b64encode(image).decode()}}] if image else [])
    body = {"system_instruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": parts}], "generationConfig": {"temperature": 0}}
    return f"/v1beta/models/{c.model}:generateContent", {"x-goog-api-key": key or ""}, body, lambda r: [p.get("text", "") for p in r["candidates"][0]["content"]["parts"]]


#: Provider -> its usual address (None: must be given) and the shape of its requests.
PROVIDERS = {
    "openai": ("https://api.openai.com/v1", _chat_completions), "databricks": (None, _serving_endpoint), "anthropic": ("https://api.anthropic.com", _messages), "google": ("https://generativelanguage.googleapis.com", _generate_content),
}


class HttpChat:
    """One question, one answer, over HTTP with the standard library."""

    def __init__(self, config: ModelConfig):
        address, self.shape = PROVIDERS[config.provider]
        self.config, self.base = config, (config.base_url or address or "").rstrip("/")
        if not self.base:
            raise ValueError(f"provider {config.provider!r} needs a base_url")
        self.key = os.environ.get(config.api_key_env) if config.api_key_env else None

    def ask(self, system: str, text: str, image: bytes | None = None) -> str:
        path, headers, body, read = self.shape(self.config, self.key, system, text, image)
        data = json.dumps(body | dict(self.config.extra)).encode()
        request = urllib.request.Request(self.base + path, data, {"Content-Type": "application/json"} | headers)
        with urllib.request.urlopen(request, timeout=self.config.timeout_seconds) as answer:
            return join_content(read(json.load(answer)))


def build_chat(config: ModelConfig):
    """Something with ``ask(system, text, image)``: the given instance, else a client of the provider."""
    if config.instance is not None:
        return config.instance
    if config.provider == "custom":
        raise ValueError("provider 'custom' needs an instance")
    if config.provider not in PROVIDERS:
        raise ValueError(f"unknown provider: {config.provider}")
    return HttpChat(config)


class PromptedModel:
    """Captions and renders by a chat, as the prompts say. Review and clean-up are further calls, each on what the call before gave."""

    def __init__(self, config: ModelConfig, *, caption_language: str = "auto", primary_language: str = "vi", review: bool = True, clean: bool = True):
        self.chat = build_chat(config)
        self.caption_system, self.steps = caption_prompt(caption_language, primary_language), render_steps(review, clean)

    def caption(self, context: str, content: bytes) -> str:
        return self.chat.ask(self.caption_system, context, content)

    def render(self, markdown: str, previous_tail: str) -> str:
        before = f"End of the part before:\n{previous_tail}\n\n" if previous_tail else ""
        out = markdown
        for name, prompt in self.steps:
            out = self.chat.ask(prompt, f"{before}Draft:\n{markdown}" if name == "render" else f"Draft:\n{markdown}\n\nRendered:\n{out}")
        return out


@dataclass(frozen=True)
class ModelOptions:
    """How a model is called. ``make`` builds it on a worker, once; nothing of it is sent from the driver.

    ``prompted`` makes the options of a ``ModelConfig``; then the languages and flags go into its prompts.
    """

    make: Callable[[], object]
    requests_per_minute: int | None = None
    tasks: int = 4
    attempts: int = 3
    caption_language: str = "auto"
    primary_language: str = "vi"
    review: bool = True
    clean: bool = True
    #: Seconds of rest between two chunks of a document.
    rest_seconds: float = 0.0

    @staticmethod
    def prompted(config: ModelConfig, **options) -> ModelOptions:
        own = {k: options[k] for k in ("caption_language", "primary_language", "review", "clean") if k in options}
        return ModelOptions(functools.partial(PromptedModel, config, **own), **options)

    def paced(self, shortcut: int | None) -> ModelOptions:
        """The same with a common rate, if the model has none of its own."""
        return replace(self, requests_per_minute=shortcut) if self.requests_per_minute is None else self


class Pacer:
    """Lets one call pass every ``60 / rate`` seconds; the tasks of a job share the rate evenly."""

    def __init__(self, per_minute: int | None, tasks: int, clock=time.monotonic, sleep=time.sleep):
        self.step = 60.0 / max(per_minute, 1) * max(tasks, 1) if per_minute else 0.0
        self.next, self.clock, self.sleep = 0.0, clock, sleep

    def wait(self) -> None:
        now = self.clock()
        if self.next > now:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.step


def with_retries(call: Callable[[], str], attempts: int, fallback: str, sleep=time.sleep) -> str:
    """The call's result, or the fallback after ``attempts`` failures, with growing pauses."""
    for k in range(attempts):
        try:
            return call()
        except Exception:  # a model may fail in any way; a document must not be lost for it
            if k + 1 < attempts:
                sleep(2**k)
    return fallback


def join_content(content) -> str:
    """The text of a model's message: a string, or a list of strings and text parts."""
    if isinstance(content, str):
        return content
    parts = (p if isinstance(p, str) else p.get("text", "") if p.get("type") == "text" else None for p in content)
    return " ".join(p for p in parts if p is not None)


def context_of(ref: dict, options: ModelOptions) -> str:
    """What a captioner is told about an image."""
    lines = [f"Container: {ref.get('container_kind') or '?'} #{ref.get('container_index')}"]
    lines += [f"{name}: {ref[key]}" for name, key in (("Label", "label"), ("Alt text", "alt_text"), ("Surrounding text", "context_text")) if ref.get(key)]
    language = options.caption_language if options.caption_language != "auto" else f"the document's, else {options.primary_language}"
    return "\n".join([*lines, f"Language of generated words: {language}"])


_WORKER: dict[str, object] = {}


def _model(name: str, options: ModelOptions):
    """The worker's model of one captioner or renderer, made when it is first needed."""
    if name not in _WORKER:
        _WORKER[name] = options.make()
    return _WORKER[name]


def captioner(options: ModelOptions) -> Callable[[DataFrame], DataFrame]:
    """A captioner for ``ConvertOptions``: each image once, ``tasks`` at a time.

    Images without bytes and SVG drawings never reach the model; an image whose calls all fail shows its alt text, else
    the placeholder.
    """
    from ..sources.model import is_svg

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pacer = Pacer(options.requests_per_minute, options.tasks)
        for batch in batches:
            said = []
            for ref in batch.to_pylist():
                alt, blob = ref.get("alt_text"), ref["content"]
                if blob is None:
                    said.append(alt or NOT_FOUND)
                elif is_svg(blob):
                    said.append(alt or NO_SVG)
                else:
                    pacer.wait()
                    said.append(with_retries(lambda r=ref, b=blob: join_content(_model(name, options).caption(context_of(r, options), b)).strip(), options.attempts, alt or NO_CAPTION))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string())], names=["doc_id", "image_id", "caption"])

    wanted = ["doc_id", "image_id", "container_kind", "container_index", "label", "alt_text", "context_text", "content"]
    return lambda refs: refs.select(*wanted).repartition(options.tasks).mapInArrow(run, "doc_id long, image_id string, caption string")


def renderer(options: ModelOptions) -> Callable[[DataFrame], DataFrame]:
    """A renderer for ``ConvertOptions``: rewrites each chunk, knowing the end of the one before as it was rendered; a chunk that fails stays as it was.

    The chunks of a document are rendered one after the other in one task, ``tasks`` documents at a time.
    """
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pacer = Pacer(options.requests_per_minute, options.tasks)
        doc, tail = object(), ""
        for batch in batches:
            at = batch.schema.get_field_index("markdown")
            out = []
            for row in batch.select(["doc_id", "markdown"]).to_pylist():
                if row["doc_id"] != doc:
                    doc, tail = row["doc_id"], ""
                elif options.rest_seconds:
                    time.sleep(options.rest_seconds)
                pacer.wait()
                out.append(with_retries(lambda r=row, t=tail: _model(name, options).render(r["markdown"], t), options.attempts, row["markdown"]))
                tail = out[-1][-TAIL:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))

    return lambda chunks: chunks.repartition(options.tasks, "doc_id").sortWithinPartitions("doc_id", "chunk_index").mapInArrow(run, chunks.schema)
