"""Token counts and token-id files with a byte-level BPE vocabulary of the tokenizers library.

A byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in order. Texts of plain
characters are cut by the pattern below, which agrees with the library's on them; other texts by the library's own
pre-tokenizer. Texts that hold an added token's string go to the library whole.
"""

from __future__ import annotations

import math
import os
import re
import string
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import Scratch, free_names, slices, small_batches, text_slices

#: Bytes of pre-tokens and ids kept per worker and generation, and what an entry takes besides its strings.
CACHE_BYTES, ENTRY_BYTES = 40 << 20, 160
#: Words that the library gets in one call.
TOGETHER = 64
#: Words that are looked up and kept at once; far fewer than a table holds.
LEARNT = 8192
#: Longer pre-tokens are encoded each time and not kept; nor are they broadcast.
CACHE_PIECE_CHARS = 64
#: The pre-tokens that most texts hold, so many at most, meet the frequencies in the workers; the others by shuffle.
HEAD_PIECES = 250_000
#: Distinct pre-tokens that a task adds up before it gives them away.
HELD_PIECES = 300_000
DEFAULT_TOKENIZER = "byte_bpe_50k.json"

# The byte-level BPE splitting pattern, written for the blocks named in _OUTSIDE.
_SPLIT = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Anything but tab, line feed, carriage return, printable ASCII, Latin letters to U+024F without
#: superscripts and fractions, and common dashes and quotes.
_OUTSIDE = "[^\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-ƺƼ-ƿǄ-ɏ–—‘-„•…€]"

#: A word and a run of these that ends a chunk are two pre-tokens.
_MARKS = string.punctuation

#: White space of other kinds than single spaces and line ends, in runs, or at an end; and empty texts.
_RUNS = r"\n\n[\n ]|\n\n\z|  | \n|\A | \z|[\t\r]|\A\z"

#: A comma or full stop with a space or line end after it that does not stand alone between them and a letter or digit.
_RUN_ON = r"(?:\A|[^\pL\pN])[,.][ \n]"
#: Begins a chunk that has no space before it. Texts with this character are not cut by Arrow.
_JOINT = "\x01"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Splitter:
    """Cuts texts into pre-tokens, and a pre-token into the vocabulary's tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.bytes_of = {ord(c): b for b, c in self.letters.items()}
        self.space = self.letters[ord(" ")]
        self.letter_of = np.array([ord(self.letters[b]) for b in range(256)], "<u4")
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        #: What a cut at single spaces and line ends may get wrong.
        self.uneven = "|".join([_OUTSIDE, _RUNS, *(re.sub(r"([^\w ])", r"\\\1", x) for x in added)])

    def tokens(self, piece: str) -> list:
        """The tokens of one pre-token, by the library's model."""
        if piece.isascii() and piece[1:].isalpha():
            return self.model.tokenize(self.space + piece[1:] if piece[0] == " " else piece)
        return self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))

    @cached_property
    def between(self) -> tuple[int, int] | None:
        """A byte of no UTF-8 text and the id of its letter, which stands in no other token: no merge crosses it. None without one."""
        model = self.model
        if model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix:
            return None
        joined = "\n".join(self.tok.get_vocab())
        fit = (b for b in (0xC0, 0xC1, *range(0xF5, 0x100)) if model.token_to_id(self.letters[b]) is not None and joined.count(self.letters[b]) == 1)
        return next(((b, model.token_to_id(self.letters[b])) for b in fit), None)

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (letters with or without a space before them) as little-endian unsigned 32-bit integers; the library gets many in one call."""
        if self.between is None or not words:
            return [np.array([t.id for t in self.tokens(w)], "<u4").tobytes() for w in words]
        byte, number = self.between
        raw = "\0".join(words).encode().replace(b"\0", bytes([byte]))
        spelt = self.letter_of[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le").split(self.letters[byte])
        ids = []
        for k in range(0, len(spelt), TOGETHER):
            ids += [t.id for t in self.model.tokenize(self.letters[byte].join(spelt[k : k + TOGETHER]))]
            ids.append(number)
        ids = np.array(ids, "<u4")
        ends = np.flatnonzero(ids == number) * 4
        blob = ids.tobytes()
        return [blob[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist())]

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def cut(self, texts: pa.Array) -> Iterator[tuple[str, list[str] | None]]:
        """Each text with its pre-tokens in order; None for one with an added token's string, which only the library reads right. Nulls are empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _OUTSIDE).to_pylist()
        for text, other in zip(texts.to_pylist(), odd):
            if self.added and self.added.search(text):
                yield text, None
            elif other:
                pieces = self.tok.pre_tokenizer.pre_tokenize_str(text)
                yield text, [p.translate(self.bytes_of).encode("latin-1").decode() for p, _ in pieces]
            else:
                yield text, _SPLIT.findall(text)


_SPLITTERS: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """The worker's own splitter; it outlives a task because workers are reused."""
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(CACHE_PIECE_CHARS)]


class PieceTable(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers, encoded when it is met for the first time.

    Two generations of at most ``CACHE_BYTES`` are held: what was not used since the last change goes.
    """

    def __init__(self, path: str):
        super().__init__()
        self.splitter = splitter(path)
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            ids = [t.id for t in self.splitter.tokens(piece)]
            value = _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)
            # Runs of white space and joints are not kept: ``chunks`` looks for a line end or a joint with a space before it, which is no such run.
            if len(piece) > CACHE_PIECE_CHARS or (len(piece) > 1 and piece.isspace()) or _JOINT in piece:
                return value
        self.keep([piece], [value])
        return value

    def keep(self, pieces: list[str], values: list[bytes]) -> None:
        size = sum(map(len, pieces)) + sum(map(len, values)) + ENTRY_BYTES * len(pieces)
        if self.held + size > CACHE_BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.update(zip(pieces, values))
        self.held += size

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words that the newer generation lacks; those that the older one lacks too are encoded together."""
        out = []
        for start in range(0, len(words), LEARNT):
            part = words[start : start + LEARNT]
            values = list(map(self.older.get, part))
            fresh = [k for k, value in enumerate(values) if value is None]
            for k, value in zip(fresh, self.splitter.words([part[k] for k in fresh])):
                values[k] = value
            out += values
            if max(map(len, part)) > CACHE_PIECE_CHARS:
                short = [k for k, word in enumerate(part) if len(word) <= CACHE_PIECE_CHARS]
                part, values = [part[k] for k in short], [values[k] for k in short]
            self.keep(part, values)
        return out

    def chunk(self, text: str) -> bytes:
        """The ids of a run of characters between two cuts."""
        return b"".join(map(self.__getitem__, _SPLIT.findall(text)))

    def chunks(self, names: list[str]) -> list[bytes]:
        """The ids of chunks with the space before them; those that begin with a line end or a joint have it too, though no text does."""
        found = list(map(self.get, names))
        missed = [k for k, value in enumerate(found) if value is None]
        plain = [k for k in missed if names[k][1:].isalpha()]
        for k, value in zip(plain, self.learn([names[k] for k in plain])):
            found[k] = value
        rest = [k for k in missed if found[k] is None]
        bares = [names[k][1:] for k in rest]
        words = [bare.rstrip(_MARKS) for bare in bares]
        pieces = [" " + word if word.isalpha() else word[1:] if word[:1] == "\n" and word[1:].isalpha() else "" for word in words]
        self.learn(list(dict.fromkeys(p for p in pieces if p and p not in self)))
        for k, bare, word, piece in zip(rest, bares, words, pieces):
            if not piece:
                found[k] = self[bare[1:]] if bare[:1] == _JOINT else self.chunk(bare if bare[:1] == "\n" else names[k]) if bare else b""
                continue
            value = self[piece] if bare[0] != "\n" else self["\n"] + self[piece]
            found[k] = value + self[bare[len(word):]] if len(bare) > len(word) else value
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (and the end).

        A pre-token begins at every single space between two other characters, at line ends and after them, and at a comma or
        full stop between a letter or digit and one of these, so most texts are cut there by Arrow; each distinct chunk of the
        batch is encoded once and its ids are laid out by number.
        """
        own = self.splitter
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, own.uneven)
        even = texts.filter(pc.invert(odd))
        spaced = pc.replace_substring(even, "\n", " \n")
        parted = pc.replace_substring(pc.replace_substring(spaced, ", ", f" {_JOINT}, "), ". ", f" {_JOINT}. ")
        lists = pc.split_pattern(pc.if_else(pc.match_substring_regex(even, _RUN_ON), spaced, parted), " ")
        begins = lists.offsets.to_numpy().astype(np.int64)
        chunks = lists.values.slice(begins[0], begins[-1] - begins[0]).dictionary_encode()
        begins -= begins[0]
        codes = chunks.indices.to_numpy().astype(np.int64)
        held = chunks.dictionary
        names = (" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), "\0 ")[0].as_py()).split("\0") if len(held) else []
        firsts = begins[:-1]
        heads = [names[c][1:] for c in codes[firsts].tolist()]
        codes[firsts] = np.arange(len(heads)) + len(names)
        blobs = self.chunks(names) + list(map(self.chunk, heads))
        ids, bounds = spread(np.frombuffer(b"".join(blobs), "<u4"), np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2, codes)
        bounds = bounds[begins]
        if not (rest := np.flatnonzero(odd.to_numpy(zero_copy_only=False))).size:
            return ids, bounds
        parts = iter([ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
        others = own.cut(texts.take(pa.array(rest)))
        laid = []
        for other in odd.to_pylist():
            if other:
                text, pieces = next(others)
                laid.append(np.asarray(own.whole(text), "<u4") if pieces is None else np.frombuffer(b"".join(map(self.__getitem__, pieces)), "<u4"))
            else:
                laid.append(next(parts))
        return np.concatenate(laid), np.concatenate([[0], np.cumsum([len(x) for x in laid])])


def spread(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists laid end to end in ``values``, picked by number: the picked lists end to end, and where each begins (and the end)."""
    starts = np.cumsum(sizes) - sizes
    held = sizes[codes]
    bounds = np.concatenate([[0], np.cumsum(held)])
    return values[np.repeat(starts[codes] - bounds[:-1], held) + np.arange(bounds[-1])], bounds


_TABLES: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """The worker's own table."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pretokens(docs: DataFrame, *, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(piece, held): every distinct pre-token and how many texts hold it. A task adds up what it has before it gives rows away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = splitter(tokenizer_path(tokenizer)), Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["piece", "held"])
            held.clear()
            return out

        for batch in slices(batches):
            for _, pieces in own.cut(batch.column(1)):
                held.update(set(pieces or ()))
            if len(held) > HELD_PIECES:
                yield rows()
        yield rows()

    return _plain(docs).mapInArrow(run, "piece string, held long").groupBy("piece").agg(F.sum("held").alias("held"))


def piece_sizes(pieces: DataFrame, *, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(piece, held, size): ``size`` is how many tokens the pre-token ``piece`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(tokenizer_path(tokenizer))
        for batch in slices(batches, 4096):
            sizes = [len(own.tokens(p)) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["piece", "held", "size"])

    return pieces.select("piece", "held").mapInArrow(run, "piece string, held long, size long")


def _head(sizes: DataFrame, most: int) -> tuple[dict[str, int], int]:
    """The sizes of the pre-tokens that most texts hold, ``most`` of them and none over ``CACHE_PIECE_CHARS`` characters; and the fewest texts that hold one."""
    top = sizes.filter(F.length("piece") <= CACHE_PIECE_CHARS).orderBy(F.desc("held"), "piece").limit(most).select("piece", "size", "held").toArrow()
    return dict(zip(top.column("piece").to_pylist(), top.column("size").to_pylist())), pc.min(top.column("held")).as_py() or 0


def count_tokens(docs: DataFrame, *, tokenizer: str = DEFAULT_TOKENIZER, limit: int = 1024, head: int = HEAD_PIECES) -> DataFrame:
    """Tokens of every whole text: the sizes of all distinct pre-tokens, each counted once, joined to the texts' frequencies and summed.

    One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). A null text counts as empty:
    0 bytes, 0 tokens. Null and repeated doc_ids stay as they are; other columns of ``docs`` are not read; an empty
    table gives no rows. Texts with an added token's string are counted by the library whole.

    A first pass gathers the distinct pre-tokens, a common one once per task, and counts each. A second pass makes every
    text's frequencies. The sizes of the ``head`` pre-tokens that most texts hold (bounded in number and length; the driver
    and each worker hold them) meet them there; the frequencies of all others are shuffled to their sizes, and each of those
    pre-tokens stands in few texts.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "token-counts")
    sizes = tables.save(piece_sizes(pretokens(docs, tokenizer=tokenizer), tokenizer=tokenizer), "sizes")
    common, cut = _head(sizes, head)
    handle = spark.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size_of = splitter(tokenizer_path(tokenizer)), handle.value.get
        for batch in slices(batches):
            known, n_bytes, rare, counts = [], [], [], []
            for text, pieces in own.cut(batch.column(1)):
                n_bytes.append(len(text.encode()))
                seen = Counter(pieces or ())
                found = list(map(size_of, seen))
                known.append(len(own.whole(text)) if pieces is None else sum(n * size for n, size in zip(seen.values(), found) if size is not None))
                others = [(p, n) for (p, n), size in zip(seen.items(), found) if size is None]
                rare.append([p for p, _ in others])
                counts.append([n for _, n in others])
            cols = [pa.array(n_bytes, pa.int64()), pa.array(known, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "known", "rare", "counts"])

    texts = _plain(docs).mapInArrow(run, "doc_id long, n_bytes long, known long, rare array<string>, counts array<int>")
    texts = tables.save(texts.withColumn("rid", F.monotonically_increasing_id()), "frequencies", compression="zstd")
    pairs = texts.select("rid", F.explode(F.arrays_zip("rare", "counts")).alias("p")).select("rid", F.col("p.rare").alias("piece"), F.col("p.counts").alias("n"))
    # A pre-token outside of the head stands in no more texts than the head's rarest, unless it is long.
    others = sizes.filter((F.col("held") <= cut) | (F.length("piece") > CACHE_PIECE_CHARS)).select("piece", "size")
    summed = pairs.join(others, "piece").groupBy("rid").agg(F.sum(F.col("n") * F.col("size")).alias("more"))
    counted = texts.select("rid", "doc_id", "n_bytes", "known").join(summed, "rid", "left")
    n = F.col("known") + F.coalesce("more", F.lit(0))
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 2, row_group_bytes: int = 16 << 20, page_bytes: int = 1 << 20, keep: tuple[str, ...] = (), part_bytes: int = 32 << 20, total_bytes: int | None = None) -> None:
    """Write every text's token ids, ``end_id`` appended, as Parquet in ascending doc_id order.

    Columns: doc_id, tokens (list of int, dictionary or delta encoded), n_tokens, part (number of the file's range of
    doc_ids, ascending), part_start (ids before it in its part) and the columns named in ``keep`` as they are. Row
    groups hold ``row_group_bytes`` and pages ``page_bytes``; column and offset indexes are written for every page, so
    that a reader can fetch metadata alone or the tokens of a few documents.

    A null text counts as empty (only the end id); null doc_ids come first; rows of one doc_id stand in order of their
    text's hash and may spread over parts, so that a doc_id with very many rows does not fill one task. Columns that are
    not asked for are not read; a column of ``keep`` whose name is written already is refused. An empty table gives an empty
    folder with the schema. A part is about ``part_bytes`` of text: how many there are follows ``total_bytes`` (measured
    where it is not given), and so memory and time of a task do not grow with the input; the worker gets it in small batches.
    """
    names = ["doc_id", "tokens", "n_tokens", "part", "part_start"]
    if clash := {*names, "text"} & set(keep):
        raise ValueError(f"these columns are written already: {sorted(clash)}")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep])
    if total_bytes is None:
        total_bytes = src.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(1, math.ceil(total_bytes / part_bytes))
    tie, spread_ = free_names(src, "tie", "spread")
    src = src.withColumn(tie, F.xxhash64("text")).withColumn(spread_, F.rand(11))
    ordered = src.repartitionByRange(parts, "doc_id", tie, spread_).sortWithinPartitions("doc_id", tie, spread_).drop(tie, spread_)
    kept = [ordered.schema[2 + i] for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        table = piece_table(tokenizer_path(tokenizer))
        for batch in text_slices(batches, 1):
            ids, ends = table.encode(batch.column(1))
            rows = batch.num_rows
            ids = np.insert(ids, ends[1:], end_id).view("<i4")
            offsets = ends + np.arange(rows + 1)
            tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            arrays = [batch.column(0), tokens, pa.array(np.diff(offsets)), pa.array(np.full(rows, part, np.int32)), pa.array(offsets[:-1] + start)]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(2 + i) for i in range(len(kept))], names=names + [f.name for f in kept])
            start += int(offsets[-1])

    schema = "doc_id long, tokens array<int>, n_tokens long, part int, part_start long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "compression": "zstd"}
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(run, schema).write.options(**options).mode("overwrite").parquet(path)


def part_bases(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_base): how many ids stand before each file's range. Only metadata columns are read.

    One row for each file; written beside the files, so that its size is known when a join with it is planned.
    """
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("part_total"))
    bases = totals.select("part", (F.sum("part_total").over(Window.orderBy("part")) - F.col("part_total")).alias("part_base"))
    bases.coalesce(1).write.mode("overwrite").parquet(f"{path}-parts")
    return spark.read.schema(bases.schema).parquet(f"{path}-parts")


def with_start(rows: DataFrame, bases: DataFrame) -> DataFrame:
    return rows.join(bases, "part").withColumn("start", F.col("part_base") + F.col("part_start")).drop("part_base", "part_start")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files' own ids.

    The digests are a table of their own, written here, so that the ids come to the workers in small batches.
    """
    names = ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            n = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), n, pa.array(crc, pa.int64())], names=names)

    rows = spark.read.parquet(path).select("doc_id", "part", "part_start", "tokens")
    digests = rows.mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    with small_batches(spark):
        digests = Scratch(spark, "token-digest").save(digests, "digests")
    return with_start(digests, part_bases(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``: how many ids stand before the row in all parts.

    One row for each file is joined to the rows; Spark broadcasts it while it is under its threshold.
    """
    rows = spark.read.parquet(path)
    return with_start(rows, part_bases(spark, path))


def encode_to_files(spark: SparkSession, docs: DataFrame, **options) -> str:
    """``write_token_files`` into a new table of the shared folder; returns its path."""
    path = Scratch(spark, "tokens").path("ids")
    write_token_files(docs, path, **options)
    return path
