"""Fill-in-the-middle transformation: texts cut at two line borders and put in another order, by a sparse checkpoint index.

While the lines of a text are counted, piece by piece, every STEP-th line border is recorded as (lines, bytes, code
points) before it. A cut is found by binary search among these checkpoints and a rescan of fewer than STEP lines behind
the checkpoint, which also counts the code points; the rest of the text is not looked at again. Memory beside the
text is one piece and a checkpoint for every STEP lines, so texts of any length are cut whole.

Units are lines, `[^\\n]*\\n|[^\\n]+`. Where a text is cut and which form it takes follow from the first four 8-digit
groups of the sha256 of seed and id, so a task that runs again gives the same rows.

Null texts are empty ones; empty texts and texts that hold a sentinel are plain, since they could not be told apart
afterwards. A null id counts as an empty one in the hash. Repeated rows are cut alike. Ties (both cuts at one border)
leave the middle empty. An empty table gives an empty result. Columns of the input that are named like a result column
are replaced, others are passed on under any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.llm.common import fresh

#: The signs before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Lines between checkpoints, and bytes that are counted at a time.
STEP, PIECE = 64, 1 << 20
#: Bytes of output that make a batch full.
BATCH_BYTES = 8 << 20

RESULT = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


class Checkpoints:
    """Every step-th line border of a text: lines, bytes and code points before it."""

    def __init__(self, raw: bytes, step: int = STEP, piece: int = PIECE):
        self.raw = raw
        units, places, points = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        n = chars = 0
        for at in range(0, len(raw), piece):
            part = np.frombuffer(raw, np.uint8, min(piece, len(raw) - at), at)
            borders = np.flatnonzero(part == 10) + 1
            sparse = np.arange(step - 1 - n % step, len(borders), step)
            begun = np.cumsum((part & 0xC0) != 0x80)
            units.append(n + 1 + sparse)
            places.append(at + borders[sparse])
            points.append(chars + begun[borders[sparse] - 1])
            n, chars = n + len(borders), chars + int(begun[-1])
        self.units, self.places, self.points = map(np.concatenate, (units, places, points))
        self.n, self.chars = n + bool(raw and raw[-1] != 10), chars

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the border that has so many lines before it."""
        if unit >= self.n:
            return len(self.raw), self.chars
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        first = end = int(self.places[k])
        for _ in range(unit - int(self.units[k])):
            end = self.raw.index(b"\n", end) + 1
        walked = np.frombuffer(self.raw, np.uint8, end - first, first)
        return end, int(self.points[k]) + int(np.count_nonzero((walked & 0xC0) != 0x80))


def transformed(raw: bytes, h: tuple[int, int, int, int], rate: int, spm_rate: int, marks: tuple[bytes, ...], step: int):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    index = Checkpoints(raw, step)
    if not raw or any(m in raw for m in marks) or h[2] % 100 >= rate:
        return index.n, "plain", None, None, raw
    first, second = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (a, a_chars), (b, b_chars) = index.cut(first), index.cut(second)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = marks
    if h[3] % 100 < spm_rate:
        return index.n, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return index.n, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


def draws(seed: int, doc_id: Column) -> Column:
    """The first four 8-digit groups of the sha256 of `seed:id`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def _check(sentinels: tuple[str, ...]) -> None:
    """Sentinels that run into each other could not be found again."""
    for x in sentinels:
        for y in sentinels:
            if not x or (x != y and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)) + (x != y))):
                raise ValueError(f"sentinels must not overlap: {x!r}, {y!r}")


def fill_in_middle(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    rate: int = 100,
    spm_rate: int = 50,
    seed: int = 7,
    sentinels: tuple[str, str, str] = SENTINELS,
    step: int = STEP,
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """docs (or its columns keep) with n, form, prefix_chars, middle_chars and output.

    rate: texts of a hundred that are cut; spm_rate: of these, how many have the suffix first.
    """
    _check(sentinels)
    taken = set(RESULT)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    body, drawn = fresh(docs, "body_", "draws_")
    source = docs.select(*[docs[c] for c in names], F.coalesce(docs[text], F.lit("")).cast("binary").alias(body), draws(seed, docs[doc_id]).alias(drawn))
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + [f"{c} {t}" for c, t in RESULT.items()])
    marks = tuple(s.encode() for s in sentinels)

    def batch(rows: pa.RecordBatch, first: int, made: list[tuple]) -> pa.RecordBatch:
        old = rows.slice(first, len(made)).columns[:-2]
        n, form, prefix, middle, out = zip(*made)
        new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays([*old, *new], names=[*names, *RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, numbers = rows.columns[-2:]
            made: list[tuple] = []
            first = held = 0
            for k in range(rows.num_rows):
                made.append(transformed(texts[k].as_py(), tuple(numbers[k].as_py()), rate, spm_rate, marks, step))
                held += len(made[-1][-1])
                if held >= BATCH_BYTES:
                    yield batch(rows, first, made)
                    first, held, made = k + 1, 0, []
            if made:
                yield batch(rows, first, made)

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from output and form alone: no cut text holds a sentinel, so these part it into three."""
    quoted = ["".join(f"\\{c}" if c.isascii() and not c.isalnum() else c for c in s) for s in sentinels]
    part = F.split(output, "|".join(quoted), -1)
    in_order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    whole = output
    for name, places in in_order.items():
        whole = F.when(form == name, F.concat(*[F.get(part, F.lit(k)) for k in places])).otherwise(whole)
    return whole
