"""Structural index of many JSON documents at once.

The documents of a batch lie in one byte buffer. Quote, bracket and delimiter positions come from one table lookup over it;
escaped quotes are told by the parity of the backslash run before them, strings by the parity of quotes, nesting depth by a
prefix sum over brackets. A stable sort by depth brings the delimiters of each container together, which gives every token its
container and every comma its ordinal without walking a tree. The same arrays tell which documents are valid JSON, at any depth.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

QUOTE, OPEN_OBJECT, OPEN_ARRAY, CLOSE_OBJECT, CLOSE_ARRAY, COMMA, COLON = range(1, 8)
#: Events besides the structural tokens: before a document's first, and a number or literal.
START, SCALAR = 0, 8
_CLASS = bytearray(256)
for _c, _k in zip(b'"{[}],:', range(1, 8)):
    _CLASS[_c] = _k
_CLASS = bytes(_CLASS)


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_BLANK = _flags(b"\t\n\r ")
_ESCAPED, _HEX = _flags(b'"\\/bfnrtu'), _flags(b"0123456789abcdefABCDEF")
_SCALAR = rb"(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)"
_ONE_SCALAR, _ALL_SCALARS = re.compile(_SCALAR), re.compile(b"(?:" + _SCALAR + b",)*+")


def _shift(a: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    out = np.full(len(a), fill, a.dtype)
    if len(a) > by:
        out[by:] = a[:-by]
    return out


class StructuralIndex:
    """Tokens of documents joined by line feeds.

    pos, kind: byte position and class of each structural token (quotes that open and close strings count; all else in strings doesn't).
    doc: the document a token lies in. level: depth of the container a token belongs to (a bracket belongs to the container it
    opens or closes). owner: index of the bracket opening that container, -1 at the top. ordinal: commas before the token in its
    container. valid: whether each document is one JSON value. colons: those of valid documents.
    """

    def __init__(self, documents: list[bytes]):
        self.raw = b"\n".join(documents) + b"\n"
        buf = self.buf = np.frombuffer(self.raw, np.uint8)
        lengths = np.fromiter((len(d) + 1 for d in documents), np.int64, len(documents))
        ends = np.cumsum(lengths)
        self.starts, self.stops = ends - lengths, ends - 1
        kind = np.frombuffer(self.raw.translate(_CLASS), np.uint8)
        pos = np.flatnonzero(kind)
        kind = kind[pos]
        self.backslashes = slashes = np.flatnonzero(buf == 92)
        escapes = slashes
        if len(slashes):
            run = np.arange(len(slashes))
            first = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) != 1, run, 0))
            odd = (run - first) % 2 == 0
            escapes = slashes[odd]
            quoted = np.flatnonzero((kind == QUOTE) & (buf[np.maximum(pos - 1, 0)] == 92) & (pos > 0))
            escaped = quoted[odd[np.searchsorted(slashes, pos[quoted] - 1)]]
            keep = np.ones(len(pos), bool)
            keep[escaped] = False
            pos, kind = pos[keep], kind[keep]
        quote = kind == QUOTE
        inside = self._within(pos, quote.astype(np.int64)) % 2
        outside = quote | (inside == 0)
        self.pos, self.kind = pos, kind = pos[outside], kind[outside]
        self.opening = (kind == QUOTE) & (inside[outside] == 1)
        self.doc = np.repeat(np.arange(len(documents)), np.diff(np.searchsorted(pos, np.append(self.starts, len(self.raw)))))
        opens = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY)
        closes = (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY)
        depth = self._within(pos, opens.astype(np.int64) - closes)
        self.level = level = depth + closes
        narrow = level.astype(np.int16) if len(level) == 0 or np.abs(level).max() < 32000 else level
        order = np.argsort(narrow, kind="stable")
        place = np.arange(len(order))
        head = np.maximum.accumulate(np.where(opens[order], place, -1))
        owned = (head >= 0) & (self.doc[order] == self.doc[order[head]]) & (level[order] == level[order[head]])
        commas = np.cumsum(kind[order] == COMMA)
        self.owner = np.full(len(order), -1)
        self.owner[order] = np.where(owned, order[head], -1)
        self.ordinal = np.zeros(len(order), np.int64)
        self.ordinal[order] = np.where(owned, commas - commas[head], 0)
        self.end = np.full(len(order), -1)
        shut = np.flatnonzero(closes & (self.owner >= 0))
        self.end[self.owner[shut]] = shut
        self.valid = self._validity(escapes, depth)
        self.colons = np.flatnonzero((kind == COLON) & self.valid[self.doc])

    def _within(self, pos: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Running sum of steps at each token, from 0 in each document."""
        total = np.cumsum(steps)
        at = np.searchsorted(pos, self.starts)
        before = np.append(0, total)[at]
        return total - np.repeat(before, np.diff(np.append(at, len(pos))))

    def _documents_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def _scalars(self, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, document) of what stands between tokens outside strings; a document with anything but numbers and literals is marked."""
        pos, doc = self.pos, self.doc
        follow = np.append(pos[1:], 0)
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        follow = np.where(last, self.stops[doc], follow)
        first = np.searchsorted(pos, self.starts)
        some = np.append(pos, 0)[first]
        some = np.where((first < len(pos)) & (some < self.stops), some, self.stops)
        begin, stop, whose = (np.concatenate(x) for x in ((self.starts, pos[~self.opening] + 1), (some, follow[~self.opening]), (np.arange(len(self.starts)), doc[~self.opening])))
        wide = begin < stop
        begin, stop, whose = begin[wide], stop[wide], whose[wide]
        todo = np.arange(len(begin))
        while len(todo := todo[(begin[todo] < stop[todo]) & _BLANK[self.buf[begin[todo]]]]):
            begin[todo] += 1
        todo = np.arange(len(begin))
        while len(todo := todo[(begin[todo] < stop[todo]) & _BLANK[self.buf[stop[todo] - 1]]]):
            stop[todo] -= 1
        wide = begin < stop
        begin, stop, whose = begin[wide], stop[wide], whose[wide]
        texts = [self.raw[a:b] for a, b in zip(begin.tolist(), stop.tolist())]
        if not _ALL_SCALARS.fullmatch(b",".join(texts) + b"," if texts else b""):
            valid[whose[[i for i, t in enumerate(texts) if not _ONE_SCALAR.fullmatch(t)]]] = False
        return begin, whose

    def _validity(self, escapes: np.ndarray, depth: np.ndarray) -> np.ndarray:
        n = len(self.starts)
        valid = np.ones(n, bool)
        if len(escapes):
            after = self.buf[escapes + 1]
            bad = ~_ESCAPED[after]
            hexes = escapes[after == ord("u")]
            for i in range(2, 6):
                short = hexes[~_HEX[self.buf[np.minimum(hexes + i, len(self.raw) - 1)]]]
                valid[self._documents_of(short)] = False
            valid[self._documents_of(escapes[bad])] = False
        quotes = self.pos[self.kind == QUOTE]
        at = np.append(np.searchsorted(quotes, self.starts), len(quotes))
        valid[np.diff(at) % 2 == 1] = False
        control = np.flatnonzero(self.buf < 32)
        whose = self._documents_of(control)
        valid[whose[((np.searchsorted(quotes, control) - at[whose]) % 2 == 1) & (control < self.stops[whose])]] = False
        begin, of = self._scalars(valid)
        token = np.flatnonzero((self.kind != QUOTE) | self.opening)
        holder = np.where(self.owner >= 0, self.kind[self.owner], 0)[token] if len(token) else np.zeros(0, np.uint8)
        pos = np.concatenate((self.pos[token], begin))
        order = np.argsort(pos, kind="stable")
        kind = np.concatenate((self.kind[token], np.full(len(begin), SCALAR, np.uint8)))[order]
        holder = np.concatenate((holder, np.zeros(len(begin), np.uint8)))[order]
        doc = np.concatenate((self.doc[token], of))[order]
        same, same2 = _shift(doc, 1, -1) == doc, _shift(doc, 2, -1) == doc
        p = np.where(same, _shift(kind, 1), START)
        pp = np.where(same2, _shift(kind, 2), START)
        held, held2 = _shift(holder, 1), _shift(holder, 2)
        key_before = (p == QUOTE) & ((pp == OPEN_OBJECT) | ((pp == COMMA) & (held2 == OPEN_OBJECT)))
        value_before = (p == QUOTE) & ~key_before | (p == SCALAR) | (p == CLOSE_OBJECT) | (p == CLOSE_ARRAY)
        may_start = (p == START) | (p == OPEN_ARRAY) | (p == COLON)
        listed = (p == COMMA) & (held == OPEN_ARRAY)
        right = np.select(
            [kind == QUOTE, kind == COLON, kind == COMMA, kind == CLOSE_OBJECT, kind == CLOSE_ARRAY],
            [may_start | (p == OPEN_OBJECT) | (p == COMMA), key_before & (holder == OPEN_OBJECT), value_before & (holder > 0), (holder == OPEN_OBJECT) & ((p == OPEN_OBJECT) | value_before), (holder == OPEN_ARRAY) & ((p == OPEN_ARRAY) | value_before)],
            may_start | listed,
        )
        valid[doc[~right]] = False
        filled = np.zeros(n, bool)
        filled[doc] = True
        if len(self.pos):
            final = np.flatnonzero(np.append(self.doc[1:] != self.doc[:-1], True))
            valid[self.doc[final[depth[final] != 0]]] = False
        return valid & filled

    def document(self, tokens: np.ndarray) -> np.ndarray:
        return self.doc[tokens]

    def value_start(self, tokens: np.ndarray) -> np.ndarray:
        """First byte that isn't blank after each token."""
        at = self.pos[tokens] + 1
        todo = np.flatnonzero(_BLANK[self.buf[at]])
        while len(todo):
            at[todo] += 1
            todo = todo[_BLANK[self.buf[at[todo]]]]
        return at

    def _string(self, start: int, stop: int) -> str:
        piece = self.raw[start:stop]
        if b"\\" in piece:
            return json.loads(b'"' + piece + b'"').encode("utf-8", "replace").decode()  # a lone surrogate becomes ?
        return piece.decode()

    def key(self, colon: int) -> str:
        return self._string(self.pos[colon - 2] + 1, self.pos[colon - 1])

    def colons_named(self, names: list[str]) -> np.ndarray:
        """For each colon the place of its key in names, or -1."""
        first, last = self.pos[self.colons - 2] + 1, self.pos[self.colons - 1]
        found = np.full(len(self.colons), -1)
        for n, name in enumerate(names):
            want = np.frombuffer(name.encode(), np.uint8)
            at = np.flatnonzero(last - first == len(want))
            for i, byte in enumerate(want):
                at = at[self.buf[first[at] + i] == byte]
            found[at] = n
        if len(self.backslashes):  # keys written with escapes
            for i in np.flatnonzero(np.searchsorted(self.backslashes, first) < np.searchsorted(self.backslashes, last)):
                key = self.key(self.colons[i])
                found[i] = names.index(key) if key in names else -1
        return found

    def texts(self, start: np.ndarray, stop: np.ndarray) -> pa.Array:
        """The bytes from each start to its stop as strings, gathered at once."""
        offsets = np.append(0, np.cumsum(stop - start))
        at = np.repeat(start - offsets[:-1], stop - start) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.buf[at]))

    def value_stop(self, start: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """End of the value at each start, which follows the given token: behind its closing bracket or quote, or its last byte."""
        first = self.buf[start]
        boxed = (first == ord("{")) | (first == ord("["))
        string = first == ord('"')
        stop = self.pos[np.minimum(tokens + 1, len(self.pos) - 1)].copy()
        stop[boxed] = self.pos[self.end[tokens[boxed] + 1]] + 1
        stop[string] = self.pos[tokens[string] + 2] + 1
        plain = np.flatnonzero(~boxed & ~string)
        while len(plain := plain[_BLANK[self.buf[stop[plain] - 1]]]):
            stop[plain] -= 1
        return stop

    def strings(self, start: np.ndarray, tokens: np.ndarray) -> list[str]:
        """The string values that start at each byte and follow each token, unescaped."""
        begin, stop = start + 1, self.pos[tokens + 2]
        out = self.texts(begin, stop).to_pylist()
        if len(self.backslashes):
            for i in np.flatnonzero(np.searchsorted(self.backslashes, begin) < np.searchsorted(self.backslashes, stop)).tolist():
                out[i] = self._string(begin[i], stop[i])
        return out
