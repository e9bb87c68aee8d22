"""Fill-in-the-middle transformation by secondary sort.

1. Each text is cut into prefix, middle and suffix at places that follow from its id.
   Its parts go out as pieces of ``UNITS`` code points at most, keyed by (row, place in
   the output); each marker is a piece of its own, and a head piece holds what is known
   of the whole row.
2. ``repartition`` by row and ``sortWithinPartitions`` by (row, place), the DataFrame form
   of repartitionAndSortWithinPartitions, stream the pieces of a row in output order
   into an incremental digest: no task ever holds a row's output.
3. To restore, the same stream gives each piece its place in the text, found by the
   markers that the output itself shows. The rows of a document are already in one
   partition, so sorting again moves nothing between tasks; the pieces in text order
   feed a second digest.

Rows are dealt by their number in the table, not by id: rows that share an id (or have
none) are as many keys. Numbers follow the scan, which a task that is run again repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, slices

#: Code points of a piece at most.
UNITS = 4096
#: The markers of prefix, suffix and middle, and the order of parts by form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE), "plain": ()}
#: Place of each part in the text.
HOME = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
PLAIN_FROM, SPM_BELOW = 90, 20

_HEAD = "row long, at long, doc_id long, n long, form string, prefix_chars long, middle_chars long, piece string"
_PLACED = "row long, home int, at long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, piece string"


def plan(doc_id: int | None, text: str, seed: str = "1") -> tuple[str, int, int]:
    """form, code points of the prefix and of the middle, of a text.

    The draws come from the sha256 of seed:doc_id (``null`` without an id), so rows
    with one id draw alike.
    """
    draw = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(draw[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= PLAIN_FROM or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return "plain", len(text), 0
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), a, b - a


def cut(text: str, form: str, prefix: int, middle: int, units: int = UNITS) -> Iterator[str]:
    """The pieces of the output, in order."""
    parts = {PREFIX: (0, prefix), MIDDLE: (prefix, prefix + middle), SUFFIX: (prefix + middle, len(text))}
    for mark, (a, b) in [(m, parts[m]) for m in ORDER[form]] or [("", (0, len(text)))]:
        if mark:
            yield mark
        for k in range(a, b, units):
            yield text[k : min(b, k + units)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS, seed: str = "1") -> DataFrame:
    """row, at and the pieces of every row's output; the head (at 0) has no piece.

    A null text is empty: its output is empty and its form plain. A null id is kept.
    """
    rows = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = {k: [] for k in ("row", "at", "doc_id", "n", "form", "prefix_chars", "middle_chars", "piece")}
                for row, doc_id, text in zip(*(part[c].to_pylist() for c in ("row", "doc_id", "text"))):
                    form, prefix, middle = plan(doc_id, text, seed)
                    plain = form == "plain"
                    body = [*cut(text, form, prefix, middle, units)]
                    rest = [None] * len(body)
                    out["row"] += [row] * (1 + len(body))
                    out["at"] += range(1 + len(body))
                    out["doc_id"] += [doc_id, *rest]
                    out["n"] += [len(text), *rest]
                    out["form"] += [form, *rest]
                    out["prefix_chars"] += [None if plain else prefix, *rest]
                    out["middle_chars"] += [None if plain else middle, *rest]
                    out["piece"] += [None, *body]
                kinds = {"form": pa.string(), "piece": pa.string()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return rows.mapInArrow(run, _HEAD)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str], batch_rows: int = 2048) -> Iterator[list[tuple]]:
    for batch in batches:
        for k in range(0, batch.num_rows, batch_rows):
            part = batch.slice(k, batch_rows)
            yield [*zip(*(part[c].to_pylist() for c in names))]


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


_PLACED_ARROW = pa.schema(
    [("row", pa.int64()), ("home", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string())]
    + [("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("piece", pa.string())]
)


def placed(sorted_pieces: DataFrame) -> DataFrame:
    """Pieces with their place in the text, and a last row of each output with its digest.

    ``sorted_pieces`` come by (row, at) within a partition. The part a piece belongs to
    follows from the output read so far and its form: the next marker due opens the next
    part. home: 0 to 2 for the pieces of prefix, middle and suffix, 3 for the last row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, due, home = None, None, (), 0

        def last():
            return (head[0], 3, 0, *head[2:7], sha.hexdigest(), None)

        for rows in _rows(batches, ["row", "at", "doc_id", "n", "form", "prefix_chars", "middle_chars", "piece"]):
            found = []
            for r in rows:
                row, at, piece = r[0], r[1], r[7]
                if at == 0:
                    if head is not None:
                        found.append(last())
                    head, sha, due, home = r, hashlib.sha256(), ORDER[r[4]], 0
                    continue
                sha.update(piece.encode())
                if due and piece.startswith(due[0]):
                    home, piece, due = HOME[due[0]], piece[len(due[0]) :], due[1:]
                if piece:
                    found.append((row, home, at, None, None, None, None, None, None, piece))
            if found:
                yield _batch(found, _PLACED_ARROW)
        if head is not None:
            yield _batch([last()], _PLACED_ARROW)

    return sorted_pieces.mapInArrow(run, _PLACED)


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def restored(sorted_placed: DataFrame) -> DataFrame:
    """One row per document from pieces sorted by (row, home, at): what is known of it and both digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256()
        for rows in _rows(batches, ["home", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "piece"]):
            found = []
            for r in rows:
                if r[0] < 3:
                    sha.update(r[7].encode())
                else:
                    found.append((*r[1:7], sha.hexdigest()))
                    sha = hashlib.sha256()
            if found:
                yield _batch(found, _OUT_ARROW)

    return sorted_placed.mapInArrow(run, _OUT)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS, seed: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row.

    Repeated rows give as many results; an empty table gives none; other columns of
    ``docs`` are not looked at, whatever their names.
    """
    dealt = pieces(docs, id_col, text_col, units, seed).repartition("row")
    return restored(placed(dealt.sortWithinPartitions("row", "at")).sortWithinPartitions("row", "home", "at"))


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS, seed: str = "1") -> DataFrame:
    """doc_id, form, output: the output texts themselves, put together from their sorted pieces."""
    dealt = pieces(docs, id_col, text_col, units, seed).repartition("row").sortWithinPartitions("row", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.string())])
        head, body = None, []
        for rows in _rows(batches, ["at", "doc_id", "form", "piece"]):
            found = []
            for at, doc_id, form, piece in rows:
                if at == 0:
                    if head is not None:
                        found.append((*head, "".join(body)))
                    head, body = (doc_id, form), []
                else:
                    body.append(piece)
            if found:
                yield _batch(found, schema)
        if head is not None:
            yield _batch([(*head, "".join(body))], schema)

    return dealt.mapInArrow(run, "doc_id long, form string, output string")


def restore(output: str, form: str) -> str:
    """The text of one output."""
    if form == "plain":
        return output
    parts, rest = {}, output
    marks = ORDER[form]
    for here, after in zip(marks, [*marks[1:], None]):
        rest = rest[len(here) :]
        parts[here], rest = (rest, "") if after is None else (rest[: rest.index(after)], rest[rest.index(after) :])
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


def op13(spark, sf_dir):
    from .common import table

    return digests(table(spark, sf_dir, "documents"))
