"""URL filters: every glob rule is a run of bits in one multiword Shift-And automaton that reads each canonical URL once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A rule of the list: verdict, host, path prefix.
Rule = tuple[str, str, str]

RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: A wildcard rule: a glob for the whole host and one for the whole path.
Glob = tuple[str, str]

# Parameters: words that mark a host's label, and paths that hold no prose.
HOST_WORDS = (
    "adult-cam", "betting", "bitcoin-double", "bonus-code", "casino", "cheap-pills", "clickbait", "coupon-codes", "crack-keygen", "credit-repair", "dating-site", "diet-pills", "doorway", "download-free", "escort", "essay-writer", "forex-signal",
    "free-ringtones", "gambling", "hot-singles", "keygen", "link-farm", "loan-fast", "lottery-win", "miracle-cure", "nulled", "online-pharmacy", "parked-domain", "payday-loan", "poker", "replica-watch", "seo-backlinks", "slot-win", "spam-farm",
    "spyware", "survey-reward", "torrent", "viagra", "warez", "xxx",
)
BLOCKED_PATHS = (
    "/ads/*", "*/adclick*", "*/affiliate/*", "/cart/*", "/cgi-bin/*", "/checkout/*", "/login*", "/logout*", "/register*", "/signup*", "/wp-admin/*", "/wp-login.php", "/xmlrpc.php", "*/feed/", "*/print/", "*/trackback/", "*/captcha/*",
    "*.apk", "*.avi", "*.bin", "*.css", "*.dmg", "*.exe", "*.gif", "*.gz", "*.iso", "*.jpg", "*.js", "*.mp3", "*.mp4", "*.png", "*.rar", "*.zip",
)


def wildcard_rules(words: tuple[str, ...] = HOST_WORDS, paths: tuple[str, ...] = BLOCKED_PATHS) -> tuple[Glob, ...]:
    """A host with a label that is one of the words or begins with it and a hyphen, at any place but the last; and the paths on any host."""
    shapes = ("{}.*", "{}-*.*", "*.{}.*", "*.{}-*.*")
    return tuple((shape.format(w), "*") for w in words for shape in shapes) + tuple(("*", p) for p in paths)


#: What decides where no rule of the list fits.
GLOBS: tuple[Glob, ...] = wildcard_rules()

#: What stands between host and path in the automaton; no wildcard reads it.
_BETWEEN = "\0"

_URL = re.compile(r"(?s)://([^/?#]*)([^?#]*)")
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def canonical(url: str | None) -> tuple[str, str]:
    """Host and path: the host after the first ``://`` with A-Z lower-cased; both empty where there is none."""
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


@dataclass
class GlobAutomaton:
    """All globs at once. ``*`` stands for any run of bytes, ``?`` for one byte; other bytes for themselves.

    A pattern of m letters takes m + 1 bits: bit 0 is its start, bit i says that its first i letters are read. A ``*``
    lets the bit before it stay. A step is ``D = ((D << 1) & B[byte]) | (D & S[byte])`` on all words of all URLs of a batch.
    A zero byte is read by a zero byte only, not by a wildcard.
    """

    masks: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    ends: list[tuple[int, int]]

    @classmethod
    def build(cls, globs) -> GlobAutomaton:
        letters, loops, starts, ends = [], [], [], []
        at = 0
        for glob in globs:
            starts.append(at)
            for byte in glob.encode():
                if byte == ord("*"):
                    loops.append(at)
                else:
                    at += 1
                    letters.append((at, byte))
            ends.append(at)
            at += 1
        words = max(1, (at + 63) // 64)
        masks, stay, start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
        bit = lambda i: np.uint64(1 << (i % 64))
        for i, byte in letters:
            if byte == ord("?"):
                masks[1:, i // 64] |= bit(i)
            else:
                masks[byte, i // 64] |= bit(i)
        for i in loops:
            stay[1:, i // 64] |= bit(i)
        for i in starts:
            start[i // 64] |= bit(i)
        return cls(masks, stay, start, [(i // 64, i % 64) for i in ends])

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Which globs match each whole text: a boolean array of texts by globs."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        joined = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else sizes
        state = np.tile(self.start, (len(texts), 1))
        live = len(texts)
        for step in range(int(sizes[0]) if len(texts) else 0):
            while live and sizes[live - 1] <= step:
                live -= 1
            d = state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            byte = joined[begin[:live] + step]
            state[:live] = (moved & self.masks[byte]) | (d & self.stay[byte])
        out = np.zeros((len(texts), len(self.ends)), bool)
        back = np.array(order, np.int64)
        for k, (word, shift) in enumerate(self.ends):
            out[back, k] = (state[:, word] >> np.uint64(shift)) & np.uint64(1) == 1
        return out


def _literal(text: str) -> str:
    if "*" in text or "?" in text:
        raise ValueError(f"a rule's host and path are plain text: {text!r}")
    return text


def rule_globs(rules) -> list[str]:
    """Two globs for each rule: its own host, and every subdomain."""
    return [g for _, host, path in rules for g in (f"{_literal(host)}{_BETWEEN}{_literal(path)}*", f"*.{host}{_BETWEEN}{path}*")]


def filter_urls(pages: DataFrame, rules=RULES, globs=GLOBS, *, default: str = "allow") -> DataFrame:
    """The verdict on every url: the longest fitting rule's; without one ``block`` where both globs of a pair match, else ``default``.

    Columns: page_id, host, path, rule (host and path prefix, null without one), verdict, glob (whether one matches). A rule's host fits itself and all its
    subdomains. Null urls and urls without ``://`` have an empty host and path and get what the globs or the default
    say. Of two rules of one length the first of the list wins. Null and repeated page_ids stay as they are, other
    columns are not read, and an empty table gives no rows. URLs are matched in batches inside each task, urls of one batch sorted by length, so that a
    very long one costs only itself.
    """
    by_length = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    names = ["page_id", "host", "path", "rule", "verdict", "glob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = GlobAutomaton.build(rule_globs(rules) + [f"{host}{_BETWEEN}{path}" for host, path in globs])
        for batch in slices(batches, 2048):
            parts = [canonical(u) for u in batch.column(1).to_pylist()]
            # A zero byte in a url would read as the end of its host.
            hit = machine.matches([f"{h.replace(_BETWEEN, ' ')}{_BETWEEN}{p.replace(_BETWEEN, ' ')}".encode() for h, p in parts])
            whole = hit[:, 2 * len(rules) :].any(axis=1)
            rule, verdict = [], []
            for k in range(len(parts)):
                best = next((i for i in by_length if hit[k, 2 * i] or hit[k, 2 * i + 1]), None)
                rule.append(None if best is None else rules[best][1] + rules[best][2])
                verdict.append(rules[best][0] if best is not None else "block" if whole[k] else default)
            cols = [pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(whole)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return src.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, glob boolean")
