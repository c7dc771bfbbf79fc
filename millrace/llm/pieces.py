"""Splitting oversized items at natural boundaries (problem 8)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What begins or ends a part of a text, as patterns over UTF-8 bytes. Fixed values.
LINE_END = re.compile(rb"\r\n|\r|\n")
LINE = re.compile(rb"(?P<blank>[ \t]*$)|(?P<fence> {0,3}(?:`{3,}|~{3,}))|(?P<heading> {0,3}(?P<rank>#{1,6})(?:[ \t]|$))|(?P<item>(?P<indent>[ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+\S)|(?P<table>[ \t]*\|)|(?P<tag>[ \t]*<[A-Za-z])")
UNDERLINE = re.compile(rb" {0,3}(?:(=+)|-{2,})[ \t]*$")
TAG = re.compile(rb"<(/?)([A-Za-z][\w:.-]*)(?:\s[^<>]*)?(/?)>")
CODE = re.compile(rb"^(?:(?:async )?def \w+\(|class \w+[(:]|import \w+|from [\w.]+ import )", re.M)
DEFINITION = re.compile(rb"(?:(?:async )?def|class)\b|@\w")
SENTENCE = re.compile(rb"[.!?]+[\"')\]]*[ \t]+|(?:\xe3\x80\x82)+")
BLANK = re.compile(rb"[ \t]+")
NAMES = ("end", "heading", "block", "element", "item", "line", "sentence", "blank", "forced")
_END, _HEADING, _BLOCK, _ELEMENT, _ITEM, _LINE, _SENTENCE, _BLANK, _FORCED = range(len(NAMES))
#: Deeper nesting is not looked at; what lies there is cut as plain lines.
DEEPEST = 40


class _Tree:
    """The structure of a text: sections by rank of headings, blocks, elements of markup, lists with their items, lines, sentences, words.

    A node is (start, end, kind) and is opened only when it is asked for its children, which cover it without gaps.
    """

    def __init__(self, b: bytes):
        self.b = b
        stops = [m.end() for m in LINE_END.finditer(b)]
        if not stops or stops[-1] < len(b):
            stops.append(len(b))
        self.starts, self.stops = [0, *stops[:-1]], stops
        self.pairs = self._match_tags()
        self.tag_starts = [p[0] for p in self.pairs]
        self.blocks: list[tuple[int, int, str]] = []
        self.heads: list[tuple[int, int]] = []
        self._scan()
        self.block_starts = [x[0] for x in self.blocks]

    def _match_tags(self) -> list[tuple[int, int]]:
        """Start and end of all elements whose tags match, in order."""
        if b"</" not in self.b:
            return []
        open_: dict[bytes, list[tuple[int, int]]] = {}
        out, made = [], 0
        for m in TAG.finditer(self.b):
            if m[3]:
                continue
            held = open_.setdefault(m[2], [])
            if not m[1]:
                held.append((m.start(), made))
            elif held:
                start, _ = held.pop()
                out.append((start, m.end()))
                made += 1
        return sorted(out, key=lambda p: (p[0], -p[1]))

    def _line(self, i: int) -> bytes:
        return self.b[self.starts[i] : self.stops[i]].rstrip(b"\r\n")

    def _scan(self) -> None:
        """Blocks of lines, each with the blank lines after it, and headings."""
        code, n, i = CODE.search(self.b) is not None, len(self.stops), 0
        kinds = [LINE.match(self._line(k)) for k in range(n)]
        blank = lambda k: k >= n or kinds[k] is not None and kinds[k].lastgroup == "blank"
        named = lambda k, name: k < n and kinds[k] is not None and kinds[k][name] is not None
        closers: dict[bytes, list[tuple[int, int]]] = {}  # lines of nothing but a fence
        for k in range(n):
            if named(k, "fence") and not (mark := self._line(k).strip()).strip(mark[:1]):
                closers.setdefault(mark[:1], []).append((k, len(mark)))
        while i < n:
            end, kind, rank = i + 1, "text", 0
            if blank(i):
                kind = "blank"
            elif named(i, "fence"):
                mark = kinds[i]["fence"].strip()
                ends = closers.get(mark[:1], [])
                close = next((k for k, long in ends[bisect_right(ends, (i, 1 << 60)) :] if long >= len(mark)), None)
                if close is not None:
                    end, kind = close + 1, "lines"
            elif named(i, "heading") and not code:
                kind, rank = "heading", len(kinds[i]["rank"])
            elif code and DEFINITION.match(self._line(i)) and (i == 0 or not DEFINITION.match(self._line(i - 1))):
                kind, rank = "heading", 1
            elif named(i, "tag") and (stop := self._element_from(i)) > self.starts[i]:
                end, kind = bisect_left(self.stops, stop) + 1, "element"
            elif named(i, "item"):
                kind = "list"
                while end < n and (not blank(end) or end + 1 < n and not blank(end + 1) and (named(end + 1, "item") or self._line(end + 1)[:1] in (b" ", b"\t"))) and not named(end, "heading") and not named(end, "fence"):
                    end += 1
            elif named(i, "table"):
                kind = "lines"
                while named(end, "table"):
                    end += 1
            elif not code and i + 1 < n and not blank(i + 1) and (under := UNDERLINE.match(self._line(i + 1))):
                end, kind, rank = i + 2, "heading", 1 if under[1] else 2
            if kind == "text":
                while end < n and not blank(end) and not any(named(end, x) for x in ("fence", "heading", "tag") if x != "heading" or not code) and not (code and DEFINITION.match(self._line(end))) and not (not code and end + 1 < n and UNDERLINE.match(self._line(end + 1)) and not blank(end + 1)):
                    end += 1
            while end < n and blank(end):
                end += 1
            start = self.starts[i]
            if kind == "heading":
                self.heads.append((start, rank))
            self.blocks.append((start, self.stops[end - 1], {"blank": "text", "heading": "text"}.get(kind, kind)))
            i = end

    def _element_from(self, line: int) -> int:
        """The end of the element that begins a line, or 0."""
        at = bisect_left(self.tag_starts, self.starts[line])
        if at < len(self.pairs) and not self.b[self.starts[line] : self.pairs[at][0]].strip():
            return self.pairs[at][1]
        return 0

    def children(self, node: tuple[int, int, str]) -> list[tuple[tuple[int, int, str], int]]:
        """Nodes below, each with the boundary at its end; none if there are no parts."""
        start, end, kind = node
        if kind == "section":
            inside = self.heads[bisect_right(self.heads, (start, 9)) : bisect_left(self.heads, (end, 0))]
            if inside:
                top = min(d for _, d in inside)
                return self._cut(start, end, [p for p, d in inside if d == top], "section", _HEADING)
            own = self.blocks[bisect_left(self.block_starts, start) : bisect_left(self.block_starts, end)]
            if len(own) > 1:
                return [(x, _BLOCK) for x in own]
            return self.children(own[0]) if own and own[0][2] != "section" else []
        if kind == "list":
            return self._items(start, end)
        if kind in ("element", "text"):
            inner = self._elements(start, end)
            if inner:
                parts, at = [], start
                for s, e in inner:
                    if s > at:
                        parts.append(((at, s, "text"), _ELEMENT))
                    parts.append(((s, e, "element"), _ELEMENT))
                    at = e
                if at < end:
                    parts.append(((at, end, "text"), _ELEMENT))
                return parts
            kind = "lines"
        for name, pattern, boundary in (("lines", LINE_END, _LINE), ("line", SENTENCE, _SENTENCE), ("sentence", BLANK, _BLANK)):
            if kind == name:
                below = {"lines": "line", "line": "sentence", "sentence": "word"}[name]
                found = self._cut(start, end, [m.end() for m in pattern.finditer(self.b, start, end)], below, boundary)
                if found:
                    return found
                kind = below
        return []

    def _cut(self, start: int, end: int, at: list[int], kind: str, boundary: int) -> list:
        at = [p for p in at if start < p < end]
        if not at:
            return []
        return [((s, e, kind), boundary) for s, e in zip([start, *at], [*at, end])]

    def _elements(self, start: int, end: int) -> list[tuple[int, int]]:
        """The outermost elements inside a range, other than the range itself."""
        out, at = [], start
        for s, e in self.pairs[bisect_left(self.tag_starts, start) : bisect_left(self.tag_starts, end)]:
            if s >= at and e <= end and (s, e) != (start, len(self.b[:end].rstrip())):
                out.append((s, e))
                at = e
        return out

    def _items(self, start: int, end: int) -> list:
        """The items of a list that are least indented; those below an item are cut when it is opened."""
        found = []
        for i in range(bisect_left(self.starts, start), bisect_left(self.starts, end)):
            m = LINE.match(self._line(i))
            if m and m["item"] is not None:
                found.append((self.starts[i], len(m["indent"].expandtabs(4))))
        inside = [x for x in found if x[0] > start]
        if not inside:
            return self.children((start, end, "lines"))
        least = min(d for _, d in inside)
        return self._cut(start, end, [p for p, d in inside if d == least], "list", _ITEM)


def _pack(tree: _Tree, capacity: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of the whole text: siblings are merged from the bottom up as long as they fit, only a node that doesn't fit is opened."""
    rest = capacity - overlap - (0 if tree.b.isascii() else 3)
    least = max(overlap, capacity // 4)
    limit = lambda start: rest if start else capacity

    def forced(start: int, end: int) -> list[tuple[int, int, int]]:
        out = []
        while end - start > limit(start):
            at = start + limit(start)
            while tree.b[at] & 0xC0 == 0x80:
                at -= 1
            out.append((start, at, _FORCED))
            start = at
        return [*out, (start, end, _FORCED)]

    def pack(node: tuple[int, int, str], depth: int) -> list[tuple[int, int, int]]:
        start, end, kind = node
        children = tree.children(node if depth < DEEPEST or kind in ("lines", "line", "sentence", "word") else (start, end, "lines"))
        if not children:
            return forced(start, end)
        out: list[tuple[int, int, int]] = []
        for child, boundary in children:
            s, e = child[0], child[1]
            fits = e - s <= limit(s)
            parts = [(s, e, boundary)] if fits else pack(child, depth + 1)
            parts[-1] = (*parts[-1][:2], boundary)
            apart = not fits and boundary <= _ITEM and bool(out) and out[-1][1] - out[-1][0] >= least
            for p in parts:
                if out and not apart and p[1] - out[-1][0] <= limit(out[-1][0]):
                    out[-1] = (out[-1][0], p[1], p[2])
                else:
                    out.append(p)
                apart = False
        return out

    return pack((0, len(tree.b), "section"), 0)


_BREAKS = bytes(32 if c in b" \t\r\n" else c for c in range(256))


def longest_stretch(b: bytes) -> int:
    """Bytes of the longest stretch without blank, tab, line end or full stop of Japanese."""
    return max(map(len, b.replace("。".encode(), b" ").translate(_BREAKS).split(b" ")), default=0)


def split_text(text: str, capacity: int, overlap: int, tree: _Tree | None = None) -> tuple[list[tuple[int, int, str]], bool]:
    """Pieces of a text as byte ranges with the kind of boundary at their end, and whether an unbroken stretch is too large.

    Every piece has at most ``capacity`` bytes and begins ``overlap`` bytes before the end of the one before (up to three
    more where a character would be cut). The text is a tree: sections of headings (``#`` or underlined), blocks, fenced code, tables,
    elements of markup, lists with nested items, lines, sentences and words; in program code ``#`` is a comment and definitions
    begin sections. From the bottom up siblings are merged while they fit, and only nodes that don't fit are opened. A text
    that fits is one piece.
    """
    if not 0 <= overlap <= capacity - 8:
        raise ValueError("overlap_tokens must be at least 8 less than capacity_tokens")
    b = tree.b if tree else text.encode("utf-8", "surrogatepass")
    run = longest_stretch(b) > capacity
    if len(b) <= capacity:
        return ([(0, len(b), NAMES[_END])] if b else []), run
    out, last = [], 0
    cuts = _pack(tree or _Tree(b), capacity, overlap)
    for k, (_, end, kind) in enumerate(cuts):
        start = last - overlap if k else 0
        while start > 0 and b[start] & 0xC0 == 0x80:
            start -= 1
        out.append((max(0, start), end, NAMES[_END if end == len(b) else kind]))
        last = end
    return out, run


_FIELDS = [("limit_id", pa.string()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("cut_at", pa.string()), ("has_run", pa.bool_()), ("piece", pa.string())]
PIECES = "limit_id string, doc_id bigint, piece_no int, n_pieces int, start_token bigint, end_token bigint, cut_at string, has_run boolean, piece string"


def _cut(limits: list[tuple[str, int, int]], with_text: bool):
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = _Tree(text.encode())
                b = tree.b
                for name, capacity, overlap in limits:
                    if len(b) > capacity:
                        parts, stretch = split_text(text, capacity, overlap, tree)
                        rows += [(name, i, k, len(parts), s, e, kind, stretch, b[s:e].decode() if with_text else None) for k, (s, e, kind) in enumerate(parts)]
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], schema=schema)

    return run


def split_oversized(documents: DataFrame, limits: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, max_limits: int = 1000) -> DataFrame:
    """The pieces of every document that is larger than a capacity of ``limits`` (``limit_id, capacity_tokens, overlap_tokens``).

    Sizes are tokens of the byte-level tokenizer: UTF-8 bytes. ``start_token`` and ``end_token`` say which tokens of the
    document a piece holds, ``cut_at`` the boundary at its end, ``has_run`` whether the document has a stretch without blank,
    tab, line end or "。" that is larger than the capacity. Texts that fit are filtered in the JVM by their length; each
    document is cut alone, whole, in a worker, without any shuffle. Null and empty texts fit. Rows with a null id are cut too
    and keep their null. Repeated rows give their pieces as often as they come. Limits with a null are left out.
    """
    small = [(r[0], r[1], r[2]) for r in limits.where("limit_id is not null and capacity_tokens is not null").select("limit_id", "capacity_tokens", F.coalesce("overlap_tokens", F.lit(0))).limit(max_limits + 1).collect()]
    if len(small) > max_limits:
        raise ValueError(f"more than {max_limits} limits")
    for _, capacity, overlap in small:
        if not 0 <= overlap <= capacity - 8:
            raise ValueError("overlap_tokens must be at least 8 less than capacity_tokens")
    least = min((c for _, c, _ in small), default=None)
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.where(F.octet_length("text") > least) if small else docs.where("false")
    return docs.mapInArrow(_cut(small, with_text), PIECES)


def oversized_cases(pieces: DataFrame) -> DataFrame:
    """``limit_id, doc_id, case_kind``: "over" for every document that was cut, besides "run" for one with too large a stretch."""
    kinds = F.when(F.col("has_run"), F.array(F.lit("over"), F.lit("run"))).otherwise(F.array(F.lit("over")))
    return pieces.where("piece_no = 0").select("limit_id", "doc_id", F.explode(kinds).alias("case_kind")).distinct()
