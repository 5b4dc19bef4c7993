"""SentencePiece encoding that keeps byte offsets, and decoding.

``encode`` gives the ids of the sentencepiece library for a BPE model file
with byte fallback, and with every id the span of UTF-8 bytes of the original
text that it stands for.

1. **Normalisation.** At each place of the text the longest key of the
   model's compiled character map (a double-array trie) is replaced by its
   value; a character without a key stays. Spaces become U+2581 and one is
   put in front. Each normalised byte keeps the place of its source.
2. **Pieces.** Two neighbouring characters that stand side by side in no
   piece are never merged, so the normalised text is cut where a character
   that no longer piece holds, or a new word, begins. New parts of a batch of
   texts are merged side by side in numpy, each best score first, and are
   remembered for a while.
3. **Projection.** Lengths of pieces add up to places in the normalised text,
   and the sources of these places are the spans. The bytes of a character
   without a piece have empty spans at its start, but for the last one, which
   has all of it (as in the library).

A task streams over its rows in groups of about a million characters (or one
longer text) and holds the ids and spans of one group. Nothing is shuffled. The model file is read on
the driver and broadcast (half a megabyte).

Defined cases: null and empty texts have the begin and end ids only, with
empty spans. Rows with null or repeated ids are rows of their own. An empty
table gives an empty result. Extra columns are dropped. Models with
user-defined or unused pieces, without byte fallback or with white space as a
suffix are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import rows_at_once

SPACE = "▁"
REMEMBERED = 300_000      # parts of text that a task remembers
GROUP = 1 << 20           # characters of texts encoded together, besides the last of them

# fixed values: numbers of fields and types in the public model format
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


# ------------------------------------------------------------ model file

def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: numbers, or bytes of strings, floats and inner messages."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(buf):
        key = number()
        wire = key & 7
        if wire == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            size = number()
        yield key >> 3, buf[at : at + size]
        at += size


class CharacterMap:
    """The compiled character map: a double-array trie of keys, and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.values = blob[4 + size :]
        root = self._child(0)
        leads = bytes(c for c in range(256) if root is not None and self._step(root, c) is not None)
        escaped = b"".join(b"\\x%02x" % c for c in leads)
        #: bytes at which no key starts
        self.plain = re.compile(b"[^" + escaped + b"]+" if leads else rb"[\s\S]+")

    def _child(self, node: int) -> int | None:
        """Where the children of a node start."""
        if not self.units:
            return None
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if self.units[node] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key at a place."""
        base, found = self._child(0), None
        for end in range(at, len(text)):
            node = self._step(base, text[end])
            if node is None:
                break
            base = self._child(node)
            if self.units[node] & 0x100:
                found = end + 1 - at, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        size, value = found
        return size, self.values[value : self.values.index(b"\0", value)]


class Normalizer:
    """Text to normalised bytes, and the source of each of these."""

    def __init__(self, charmap: bytes, add_dummy_prefix: bool, remove_extra_whitespaces: bool,
                 escape_whitespaces: bool):
        self.map = CharacterMap(charmap)
        self.prefix, self.squeeze = add_dummy_prefix, remove_extra_whitespaces
        self.space = SPACE.encode() if escape_whitespaces else b" "

    def _hits(self, raw: bytes) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
        """Stretches ``(begin, end, replacement, sources)`` that make up the text."""
        at = 0
        while at < len(raw):
            if m := self.map.plain.match(raw, at):
                yield at, m.end(), m[0], np.arange(at, m.end())
                at = m.end()
                continue
            size, new = self.map.longest(raw, at) or (0, b"")
            if not size:  # one character as it is
                size = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                new = raw[at : at + size]
            yield at, at + size, new, np.full(len(new), at)
            at += size

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each (and for the end) the place in the original bytes."""
        raw = text.encode("utf-8")
        if not raw:
            return b"", np.zeros(1, np.int64)
        hits = list(self._hits(raw))
        norm = b"".join(h[2] for h in hits)
        source = np.concatenate([*(h[3] for h in hits), [len(raw)]])
        first = 0
        if self.squeeze:  # no blank in front, one at a time between
            data = np.frombuffer(norm, np.uint8)
            blank = data == 0x20
            keep = ~(blank & np.r_[True, blank[:-1]][: len(blank)])
            norm, source = data[keep].tobytes(), np.r_[source[:-1][keep], len(raw)]
            for begin, end, new, _ in hits:  # the prefix stands behind the blanks left out in front
                blanks = len(new) - len(new.lstrip(b" "))
                first = end if new == b" " else begin + blanks if new == raw[begin:end] else begin
                if first < end:
                    break
            else:
                return b"", np.zeros(1, np.int64)
        blank = np.frombuffer(norm, np.uint8) == 0x20
        pad = len(self.space) if self.prefix else 0
        times = np.ones(pad + len(source), np.int64)
        times[pad:-1][blank] = len(self.space)
        source = np.repeat(np.r_[np.full(pad, first), source], times)
        norm = self.space * self.prefix + norm.replace(b" ", self.space)
        if self.squeeze:
            end = len(norm)
            while norm.endswith(self.space, 0, end):
                end -= len(self.space)
            norm, source = norm[:end], source[: end + 1]
        return norm, source


class Merges:
    """Merges of neighbouring pieces, best score first and leftmost of equals, for many parts at once."""

    LONGEST = 48  # characters of a part that is merged beside others; longer ones are merged alone

    def __init__(self, scores: dict[str, tuple[float, int]]):
        self.scores = scores
        order = {s: i for i, s in enumerate(sorted({s for s, _ in scores.values()}, reverse=True))}
        self.first = np.full(0x110000, -1, np.int32)
        pairs = {}
        for name, (score, at) in scores.items():
            if len(name) == 1:
                self.first[ord(name)] = at
            for cut in range(1, len(name)):
                left, right = scores.get(name[:cut]), scores.get(name[cut:])
                if left and right:
                    pairs[left[1] << 32 | right[1]] = order[score] << 32 | at
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.r_[keys, np.iinfo(np.int64).max]
        self.result = np.r_[np.array([pairs[k] for k in keys.tolist()], np.int64), self.NONE]

    NONE = np.int64(1 << 62)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Order of the merge and its piece, packed; ``NONE`` where there is no merge."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.result[at], self.NONE)

    def together(self, parts: list[str]) -> list[bytes]:
        """Packed ids of parts of known characters, ``LONGEST`` at most."""
        sizes = np.array([len(p) for p in parts])
        sym = self.first[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)].astype(np.int64)
        part = np.repeat(np.arange(len(parts)), sizes)
        ids, owner = [], []
        follows = np.r_[part[1:] == part[:-1], False]
        best = np.full(len(sym), self.NONE)
        best[follows] = self._look(sym[follows], sym[np.flatnonzero(follows) + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            count = np.diff(np.r_[start, len(sym)])
            least = np.minimum.reduceat(best >> 32, start)
            busy = least < self.NONE >> 32
            stays = np.repeat(busy, count)
            ids.append(sym[~stays])
            owner.append(part[~stays])
            if not busy.any():
                break
            mine = (best >> 32 == np.repeat(least, count)) & stays
            where = np.flatnonzero(mine)
            where = where[np.r_[True, part[where][1:] != part[where][:-1]]]  # leftmost of equals
            sym[where] = best[where] & 0xFFFFFFFF
            stays[where + 1] = False
            new = (np.cumsum(stays) - 1)[where]
            sym, part, best = sym[stays], part[stays], best[stays]
            for at in (new, new - 1):  # pairs that the merge has changed
                at = at[at >= 0]
                right = np.minimum(at + 1, len(sym) - 1)
                same = (at + 1 < len(sym)) & (part[right] == part[at])
                best[at] = np.where(same, self._look(sym[at], sym[right]), self.NONE)
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        packed = ids[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(parts)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def alone(self, part: str) -> list[str]:
        """Pieces and unknown characters of one part, of any length."""
        scores, piece = self.scores, list(part)
        after = [*range(1, len(piece)), -1]
        before = list(range(-1, len(piece) - 1))
        queue = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (hit := scores.get(piece[left] + piece[right])):
                heapq.heappush(queue, (-hit[0], left, right, len(piece[left]) + len(piece[right])))

        for left in range(len(piece) - 1):
            offer(left, left + 1)
        while queue:
            _, left, right, size = heapq.heappop(queue)
            if not piece[left] or not piece[right] or len(piece[left]) + len(piece[right]) != size:
                continue  # one of the two has been merged since
            piece[left] += piece[right]
            piece[right] = ""
            after[left] = follower = after[right]
            if follower >= 0:
                before[follower] = left
            offer(before[left], left)
            offer(left, follower)
        return [p for p in piece if p]


class Encoder:
    """Ids and byte spans of texts for one model."""

    def __init__(self, model: bytes):
        pieces, spec, trainer = [], {}, {}
        for field, value in _fields(model):
            if field == PIECE:
                pieces.append(dict(_fields(value)))
            elif field == NORMALIZER:
                spec = dict(_fields(value))
            elif field == TRAINER:
                trainer = dict(_fields(value))
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only BPE models with byte fallback and plain pieces are supported")
        names = [p[1].decode("utf-8") for p in pieces]
        self.normalize = Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)),
                                    bool(spec.get(5, 1)))
        self.scores = {n: (struct.unpack("<f", p[2])[0] if 2 in p else 0.0, i)
                       for i, (n, p, k) in enumerate(zip(names, pieces, kinds)) if k == NORMAL}
        self.merges = Merges(self.scores)
        self.byte = [i for _, i in sorted((int(n[3:5], 16), i) for i, (n, k) in enumerate(zip(names, kinds))
                                          if k == BYTE)]
        self.sizes = np.array([len(n.encode("utf-8")) for n in names], np.int64)
        #: characters in bytes by the id of their first byte, 0 for all other pieces
        self.lead = np.zeros(len(names), np.int64)
        for size, low, high in ((1, 0, 0x80), (2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF5)):
            self.lead[self.byte[low:high]] = size
        self.sizes[self.byte] = 0
        self.begin, self.end = (struct.pack("<I", trainer.get(k, k - 40)) for k in (41, 42))
        self.parts = self._cutter()
        single = "".join(re.escape(n) for n in self.scores if len(n) == 1)
        self.usual = re.compile(f"[{single}]{{1,{Merges.LONGEST}}}")
        self.known: dict[str, bytes] = {}

    def _cutter(self) -> re.Pattern:
        """Parts between which no piece reaches over."""
        within = [n for n in self.scores if len(n) > 1]
        joined = set("".join(within)) - {SPACE}
        inner = "".join(map(re.escape, sorted(joined)))
        if any(SPACE in n.lstrip(SPACE) for n in within):  # pieces over several words: no cuts at spaces
            return re.compile(f"[{SPACE}{inner}]+|[^{SPACE}{inner}]+")
        if not joined:
            return re.compile(f"{SPACE}+|[^{SPACE}]+")
        return re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{SPACE}{inner}]+")

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Packed ids of parts not met before. Short ones are remembered."""
        together, got, usual = [], {}, self.usual.fullmatch
        for p in parts:
            if usual(p):
                together.append(p)
                continue
            ids = []
            for q in self.merges.alone(p):
                hit = self.scores.get(q)
                ids += [hit[1]] if hit else [self.byte[c] for c in q.encode("utf-8")]
            got[p] = np.array(ids, "<u4").tobytes()
        if together:
            short = dict(zip(together, self.merges.together(together)))
            if len(self.known) + len(short) > REMEMBERED:
                self.known.clear()
            self.known.update(short)
            got.update(short)
        return got

    def _spans(self, ids: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Places in the original text between which the pieces stand."""
        size = self.sizes[ids]
        lead = np.flatnonzero(self.lead[ids])
        size[lead + self.lead[ids[lead]] - 1] += self.lead[ids[lead]]
        return source[np.r_[0, np.cumsum(size)]]

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """Packed little-endian ids (u32), and begins and ends of their spans (u64), of each text."""
        norms = [self.normalize(t or "") for t in texts]
        cut = [self.parts.findall(n.decode("utf-8")) for n, _ in norms]
        # what the batch needs is held by itself, as the memory may be cleared meanwhile
        met = set().union(*cut)
        mine = {p: self.known[p] for p in met if p in self.known}
        mine |= self._learn(met - mine.keys())
        for parts, (_, source) in zip(cut, norms):
            ids = b"".join([mine[p] for p in parts])
            at = self._spans(np.frombuffer(ids, "<u4").astype(np.int64), source)
            # the begin id has the empty span at 0, the end id that at the end
            begins, ends = np.r_[0, at], np.r_[0, at[1:], source[-1]]
            yield self.begin + ids + self.end, begins.astype("<u8").tobytes(), ends.astype("<u8").tobytes()


# ------------------------------------------------------------ operators

def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, begins, ends)`` of every row; begin and end ids included.

    ``ids`` packs little-endian unsigned 32-bit integers; ``begins`` and
    ``ends`` pack 64-bit ones, byte offsets into the UTF-8 of the text.
    """
    rows_at_once(docs.sparkSession)
    model = _model(docs, model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                        ("begins", pa.binary()), ("ends", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = Encoder(model.value)
        for batch in batches:
            texts, at = batch["text"].to_pylist(), 0
            while at < len(texts):
                end, chars = at + 1, len(texts[at] or "")
                while end < len(texts) and chars < GROUP:
                    chars += len(texts[end] or "")
                    end += 1
                ids, begins, ends = zip(*encoder(texts[at:end]))
                yield pa.record_batch([batch["doc_id"].slice(at, end - at),
                                       pa.array([len(i) // 4 for i in ids], pa.int64()),
                                       *(pa.array(c, pa.binary()) for c in (ids, begins, ends))], schema=schema)
                at = end

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, begins binary, ends binary")


def decode(ids: Column, docs: DataFrame, model_path: str) -> Column:
    """Text of packed ids, by the library's ``decode``."""
    model = _model(docs, model_path)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for packed in batches:
            yield pa.array([processor.decode(np.frombuffer(p.as_py(), "<u4").tolist()) for p in packed], pa.string())

    return text(ids)
