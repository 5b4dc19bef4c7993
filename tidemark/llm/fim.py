"""Fill-in-the-middle over seekable compressed texts.

1. **Store.** A text is cut into frames of at most ``FRAME`` code points, each
   compressed by itself with zstandard. A row keeps the frames one behind the
   other, with the cumulative numbers of code points and of bytes at which
   they end: a seekable text. The texts are stored once.
2. **Rearrange.** Two cuts, drawn from the sha256 of the id, split a text into
   prefix, middle and suffix. Only the frames that hold a cut are decompressed
   (and their halves compressed again); all other frames are moved as they are.
   The output, markers included, is a seekable text of its own.
3. **Read.** Digests and restored texts come from the output's frames, streamed
   in their order, one frame decompressed at a time. ``restore`` looks for the
   markers in the output, seeks to the parts behind them and puts them in
   order; it needs the output and the form only.

Nothing is shuffled; a task holds the compressed texts of one Arrow batch and
one decompressed frame.

Defined cases: a null text is empty, and plain like every text that is empty
or holds a marker. A null id is hashed as an empty string. Repeated rows are
rows of their own (with equal results). An empty table gives an empty result.
Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, rows_at_once

FRAME = 1 << 15           # code points of a frame, at most
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: order of the parts of a text (0 prefix, 1 middle, 2 suffix) in the output, with the markers before them
ORDER = {PSM: ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), SPM: ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}


# ------------------------------------------------------------ seekable texts

class Seekable:
    """Compressed frames, with the code points up to the end of each."""

    def __init__(self, frames: list[bytes] | None = None, upto: list[int] | None = None):
        self.frames, self.upto = frames or [], upto or []

    @classmethod
    def unpack(cls, blob: bytes) -> Seekable:
        """From ``count, then (code points, bytes) up to the end of each frame, then the frames``."""
        n = struct.unpack_from("<Q", blob)[0]
        ends = struct.unpack_from(f"<{2 * n}Q", blob, 8)
        body = memoryview(blob)[8 + 16 * n :]
        return cls([body[a:b] for a, b in zip((0, *ends[n:]), ends[n:])], list(ends[:n]))

    def pack(self) -> bytes:
        at, ends = 0, []
        for f in self.frames:
            at += len(f)
            ends.append(at)
        n = len(self.frames)
        return b"".join([struct.pack(f"<{2 * n + 1}Q", n, *self.upto, *ends), *self.frames])

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0


class Codec:
    """Compresses and decompresses frames; one for each task."""

    def __init__(self, level: int = 3, frame: int = FRAME):
        from zstandard import ZstdCompressor, ZstdDecompressor

        self.frame = frame
        self.packer, self.reader = ZstdCompressor(level=level), ZstdDecompressor()

    def add(self, out: Seekable, text: str) -> None:
        """Append a text in frames of its own."""
        for at in range(0, len(text), self.frame):
            piece = text[at : at + self.frame]
            out.frames.append(self.packer.compress(piece.encode("utf-8")))
            out.upto.append(len(out) + len(piece))

    def store(self, text: str) -> Seekable:
        out = Seekable()
        self.add(out, text)
        return out

    def text(self, frame: bytes) -> str:
        return self.reader.decompress(frame).decode("utf-8")

    def stream(self, s: Seekable) -> Iterator[str]:
        return map(self.text, s.frames)

    def move(self, out: Seekable, s: Seekable, begin: int, end: int) -> None:
        """Append the code points ``begin`` to ``end`` of ``s``; whole frames are not opened."""
        k = bisect_right(s.upto, begin)
        while begin < end:
            low = s.upto[k - 1] if k else 0
            high = s.upto[k]
            if begin == low and high <= end:
                out.frames.append(s.frames[k])
                out.upto.append(len(out) + high - low)
            else:
                self.add(out, self.text(s.frames[k])[begin - low : end - low])
            begin, k = min(high, end), k + 1

    def rearrange(self, s: Seekable, form: str, cuts: tuple[int, int]) -> Seekable:
        if form == PLAIN:
            return s
        places = (0, *cuts, len(s))
        out = Seekable()
        for marker, part in ORDER[form]:
            self.add(out, marker)
            self.move(out, s, places[part], places[part + 1])
        return out

    def find(self, s: Seekable, marks: Iterable[str]) -> dict[str, int]:
        """Where each mark begins first, in code points; frames are read in order, as far as needed."""
        left, found, tail, at = set(marks), {}, "", 0
        keep = max(map(len, left), default=1) - 1
        for piece in self.stream(s):
            here = tail + piece
            for m in list(left):
                if (k := here.find(m)) >= 0:
                    found[m] = at - len(tail) + k
                    left.discard(m)
            if not left:
                break
            at += len(piece)
            tail = here[len(here) - keep :] if len(here) > keep else here
        return found

    def restore(self, s: Seekable, form: str) -> Seekable:
        """The original text of an output."""
        if form == PLAIN:
            return s
        at = self.find(s, MARKERS)
        order = ORDER[form]
        ends = [at[m] for m, _ in order[1:]] + [len(s)]
        parts = {part: (at[m] + len(m), end) for (m, part), end in zip(order, ends)}
        out = Seekable()
        for part in (0, 1, 2):
            self.move(out, s, *parts[part])
        return out

    def sha256(self, s: Seekable) -> str:
        digest = hashlib.sha256()
        for frame in s.frames:
            digest.update(self.reader.decompress(frame))
        return digest.hexdigest()


# ------------------------------------------------------------ operators

def store(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """``(doc_id, n, marked, stored)``: texts as seekable blobs; ``marked`` tells whether a marker is inside."""
    rows_at_once(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("stored", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        codec = Codec(frame=frame)
        for b in batches:
            rows = []
            for text in b["text"]:
                t = text.as_py() or ""
                rows.append((len(t), any(m in t for m in MARKERS), codec.store(t).pack()))
            if rows:
                yield pa.record_batch([b["doc_id"], *map(pa.array, zip(*rows))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, marked boolean, stored binary")


def draw(doc_id: Column, k: int, seed: str = "1:") -> Column:
    """The k-th (from 1) group of eight hex digits of the sha256 of the seed and the id, as a number."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * k - 7, 8), 16, 10).cast("long")


def plan(stored: DataFrame, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Adds ``form`` and the cuts ``low`` and ``high`` (code points) to stored texts."""
    h = [draw(F.col("doc_id"), k) for k in (1, 2, 3, 4)]
    one, two = (x % (F.col("n") + 1) for x in h[:2])
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= plain_from)
    form = F.when(plain, PLAIN).when(h[3] % 100 < spm_below, SPM).otherwise(PSM)
    return stored.withColumns({"form": form, "low": F.least(one, two), "high": F.greatest(one, two)})


def rearrange(planned: DataFrame, frame: int = FRAME) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``; ``output`` is a seekable blob."""
    schema = "doc_id long, n long, form string, low long, high long, output binary"

    def run(batches: Iterator[pa.RecordBatch]):
        codec = Codec(frame=frame)
        for b in batches:
            cuts = zip(b["form"].to_pylist(), b["low"].to_pylist(), b["high"].to_pylist())
            out = [codec.rearrange(Seekable.unpack(s.as_py()), form, (low, high)).pack()
                   for s, (form, low, high) in zip(b["stored"], cuts)]
            yield pa.record_batch([*(b[c] for c in ("doc_id", "n", "form", "low", "high")),
                                   pa.array(out, pa.binary())],
                                  names=["doc_id", "n", "form", "low", "high", "output"])

    part = F.col("form") != PLAIN
    return (planned.select("doc_id", "n", "form", "low", "high", "stored").mapInArrow(run, schema)
            .select("doc_id", "n", "form", F.when(part, F.col("low")).alias("prefix_chars"),
                    F.when(part, F.col("high") - F.col("low")).alias("middle_chars"), "output"))


def restore(output: Column, form: Column) -> Column:
    """Seekable blob of the original text, from the output and its form alone."""
    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        codec = Codec()
        for blobs, forms in batches:
            yield pa.array([codec.restore(Seekable.unpack(s.as_py()), f.as_py()).pack()
                            for s, f in zip(blobs, forms)], pa.binary())

    return run(output, form)


def text_sha256(blob: Column) -> Column:
    """sha256 of a seekable text, its frames streamed in order."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec()
        for blobs in batches:
            yield pa.array([codec.sha256(Seekable.unpack(s.as_py())) for s in blobs], pa.string())

    return run(blob)


def fill_in_middle(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """Rearranged texts of all rows, from a written table of seekable texts: see ``rearrange``."""
    stored = Scratch(docs.sparkSession, "fim").write(store(docs, frame), "stored")
    return rearrange(plan(stored), frame)
