"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tables import stored

ROLES = ("system", "user", "assistant")
#: Lines decoded together; longer conversations are cut and their parts joined exactly.
BLOCK_LINES = 4096
#: How many lines a marker of a role counts for that role before any is seen.
MARKER_BELIEF = 50.0
# Words that open a line of a role, in transcripts of common chat formats.
MARKERS = {
    "system": ("system", "instruction", "instructions"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a"),
}
_LEAD = r"(?is)^\s*(?:#{1,6}\s*|<\|(?:im_start\|>)?\s*|\*\*|\[)?"
_TAIL = r"\s*(?:\*\*\s*:|:\s*\*\*|:|\|>|\]|$)\s*"
_SYMBOLS = (len(ROLES) + 1) * 2 * 4 * 2


class Model(NamedTuple):
    """Log probabilities: of the first role, of the next one at an opening line and inside a record, of symbols by role."""

    start: np.ndarray
    change: np.ndarray
    stay: np.ndarray
    emission: np.ndarray


def _pattern(role: str) -> str:
    return f"{_LEAD}(?:{'|'.join(MARKERS[role])}){_TAIL}"


def lines_of(transcripts: DataFrame, *, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """(conv, place, line_no, line, symbol, opens): every line and what is seen of it.

    The symbol joins the marker's role (or none), whether the line opens a record, its length in
    four steps and whether it asks. NULL texts are one empty line.
    """
    parts = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    rows = transcripts.select(F.col(id_col).alias("conv"), F.col(order_col).alias("place"), parts.alias("line_no", "line"))
    marker = F.coalesce(*[F.when(F.col("line").rlike(_pattern(r)), k + 1) for k, r in enumerate(ROLES)], F.lit(0))
    size = F.length("line")
    step = F.when(size < 40, 0).when(size < 160, 1).when(size < 640, 2).otherwise(3)
    asks = F.rtrim("line").endswith("?").cast("int")
    opens = (F.col("line_no") == 0).cast("int")
    return rows.select(
        "conv", "place", "line_no", "line",
        (((marker * 2 + opens) * 4 + step) * 2 + asks).cast("int").alias("symbol"),
        ((opens == 1) | (marker > 0)).cast("int").alias("opens"),
    )


def fit(known: DataFrame, *, id_col="conv_id", order_col="turn", text_col="text", role_col="role") -> Model:
    """The model, counted on rows of known role.

    Counts are sums over all rows; a role follows the one of the row before it in its conversation. For
    that, rows are paired inside runs of turns and the ends of the runs separately, so one long
    conversation is not one window. Rows of other roles are left out.
    """
    rows = known.filter(F.col(role_col).isin(*ROLES))
    emitted = (
        lines_of(rows.withColumn("_r", F.struct(order_col, role_col)), id_col=id_col, order_col="_r", text_col=text_col)
        .groupBy(F.col(f"place.{role_col}").alias("role"), "symbol")
        .count()
    )
    turns = rows.select(F.col(id_col).alias("conv"), F.col(order_col).alias("at"), F.col(role_col).alias("role"))
    turns = turns.withColumn("run", F.floor(F.col("at") / 1024)).filter("conv is not null and at is not null")
    follows = F.lag("role").over(Window.partitionBy("conv", "run").orderBy("at", "role"))
    inside = turns.select("role", follows.alias("before")).filter("before is not null")
    ends = turns.groupBy("conv", "run").agg(
        F.min(F.struct("at", "role"))["role"].alias("role"), F.max(F.struct("at", "role"))["role"].alias("last")
    )
    joins = ends.select("role", F.lag("last").over(Window.partitionBy("conv").orderBy("run")).alias("before"))
    changes = inside.unionByName(joins).groupBy("before", "role").count()
    number = {r: k for k, r in enumerate(ROLES)}
    emission = np.ones((3, _SYMBOLS))
    for k in range(3):
        emission[k, (k + 1) * 16 : (k + 2) * 16] += MARKER_BELIEF
    for r in emitted.collect():  # at most roles x symbols rows
        emission[number[r["role"]], r["symbol"]] += r["count"]
    start, change = np.ones(3), np.ones((3, 3))
    for r in changes.collect():  # at most 12 rows
        if r["before"] is None:
            start[number[r["role"]]] += r["count"]
        else:
            change[number[r["before"]], number[r["role"]]] += r["count"]
    stay = np.full((3, 3), 1e-4) + np.eye(3)
    counts = start[None], change, stay, emission
    start, change, stay, emission = (np.log(c / c.sum(1, keepdims=True)) for c in counts)
    return Model(start[0], change, stay, emission)


def transfer(model: Model, symbols: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """best[i, j]: the likeliest path over the lines that enters from role i and ends in role j."""
    _, change, stay, emission = model
    best = np.where(np.eye(3, dtype=bool), 0.0, -np.inf)
    for symbol, opening in zip(symbols, opens, strict=True):
        step = (change if opening else stay) + emission[:, symbol]
        best = (best[:, :, None] + step).max(1)
    return best


def viterbi(model: Model, symbols: np.ndarray, opens: np.ndarray, entry: int = -1, exit_: int = -1) -> list[int]:
    """The likeliest roles of consecutive lines, given the role before them and that of the last one where known."""
    start, change, stay, emission = model
    back, best = [], None
    for symbol, opening in zip(symbols, opens, strict=True):
        table = change if opening else stay
        if best is None:
            best = (start if entry < 0 else table[entry]) + emission[:, symbol]
            continue
        paths = best[:, None] + table
        back.append(paths.argmax(0))
        best = paths.max(0) + emission[:, symbol]
    roles = [exit_ if exit_ >= 0 else int(best.argmax())]
    for came in reversed(back):
        roles.append(int(came[roles[-1]]))
    return roles[::-1]


def _blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted lines of a partition and cuts them into blocks."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in frames:
        number = np.arange(seen, seen + batch.num_rows)
        seen += batch.num_rows
        block = (part << 40) + number // BLOCK_LINES
        yield pa.record_batch([*batch.columns, pa.array(block), pa.array(number)], names=[*batch.schema.names, "block", "number"])


def _runs(frame: pd.DataFrame) -> list[tuple[int, int]]:
    """First and last row of each conversation in a block."""
    conv = frame["conv_key"].to_numpy()
    cuts = np.flatnonzero(conv[1:] != conv[:-1]) + 1
    return list(zip([0, *cuts], [*cuts, len(conv)], strict=True))


def roles(transcripts: DataFrame, model: Model, *, id_col="conv_id", order_col="turn", text_col="text") -> DataFrame:
    """(conv, place, row, line_no, line, role, block, number): every line with its role on the likeliest path of its conversation.

    Lines are range-sorted by conversation and place, so a long conversation spreads over
    partitions, and cut into blocks. A conversation that touches a block's edge may go on in the next: each
    of its blocks becomes a 3 x 3 matrix of best paths, the matrices of a conversation are chained to
    its roles at the edges, and every block is then decoded between them. The result is
    the Viterbi path of the whole conversation. Ties in place are ordered by text; NULL ids form one conversation.
    """
    # A record stays together: records with equal places are told apart by text, equal ones by row.
    place = F.struct(
        F.col(order_col).alias("o"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"),
        F.monotonically_increasing_id().alias("row"),
    )
    lines = lines_of(transcripts.withColumn("_place", place), id_col=id_col, order_col="_place", text_col=text_col)
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit(""))
    flat = lines.select("conv", key.alias("conv_key"), F.col("place.o").alias("place"), "place.t", "place.row", "line_no", "line", "symbol", "opens")
    order = ["conv_key", "place", "t", "row", "line_no"]
    ranged = flat.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields)
    cut = stored(ranged.mapInArrow(_blocks, f"{schema}, block bigint, number bigint"), "lines")

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        frame, found = frame.sort_values("number"), []
        runs = _runs(frame)
        for first, last in {runs[0], runs[-1]}:
            part = frame.iloc[first:last]
            matrix = transfer(model, part["symbol"].to_numpy(), part["opens"].to_numpy())
            head = viterbi_head(model, int(part["symbol"].iloc[0]), part["symbol"].to_numpy()[1:], part["opens"].to_numpy()[1:])
            found.append((part["conv_key"].iloc[0], int(frame["block"].iloc[0]), int(part["number"].iloc[0]), matrix.ravel().tolist(), head.tolist()))
        return pd.DataFrame(found, columns=["conv_key", "block", "number", "matrix", "head"])

    small = cut.select("conv_key", "block", "number", "symbol", "opens")
    met = small.groupBy("block").applyInPandas(
        edges, "conv_key string, block bigint, number bigint, matrix array<double>, head array<double>"
    )

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "number"])
        best, back = None, []
        for matrix, head in zip(frame["matrix"], frame["head"], strict=True):
            if best is None:
                best = np.asarray(head)
                continue
            paths = best[:, None] + np.asarray(matrix).reshape(3, 3)
            back.append(paths.argmax(0))
            best = paths.max(0)
        ends = [int(best.argmax())]
        for came in reversed(back):
            ends.append(int(came[ends[-1]]))
        ends = ends[::-1]
        return pd.DataFrame({"block": frame["block"], "start": frame["number"], "entry": [-1, *ends[:-1]], "end": ends})

    states = met.groupBy("conv_key").applyInPandas(chain, "block bigint, start bigint, entry int, end int")

    def decode(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values("number"), []
        at = {s: (int(a), int(b)) for s, a, b in zip(known["start"], known["entry"], known["end"], strict=True)}
        for first, last in _runs(frame):
            part = frame.iloc[first:last]
            entry, end = at.get(int(part["number"].iloc[0]), (-1, -1))
            out += viterbi(model, part["symbol"].to_numpy(), part["opens"].to_numpy(), entry, end)
        return pd.DataFrame({"block": frame["block"], "number": frame["number"], "role": [ROLES[r] for r in out]})

    decoded = small.groupBy("block").cogroup(states.groupBy("block")).applyInPandas(decode, "block bigint, number bigint, role string")
    return cut.join(decoded, ["block", "number"]).select(
        "conv", "place", "row", "line_no", "line", "role", "block", "number"
    )


def viterbi_head(model: Model, first: int, symbols: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Best path score by last role of lines that begin a conversation."""
    start, _, _, emission = model
    return ((start + emission[:, first])[:, None] + transfer(model, symbols, opens)).max(0)


def without_marker(line: Column) -> Column:
    return F.regexp_replace(line, "|".join(f"(?:{_pattern(r)})" for r in ROLES), "")


def turns(found: DataFrame) -> DataFrame:
    """(conv, place, part, role, text): canonical turns; a record splits where its role changes.

    Lines of one record and one role are joined again without markers, in order.
    """
    inside = Window.partitionBy("row").orderBy("line_no")
    changed = F.coalesce((F.lag("role").over(inside) != F.col("role")).cast("int"), F.lit(0))
    parted = found.withColumn("_changed", changed).withColumn("part", F.sum("_changed").over(inside))
    entry = F.struct("line_no", without_marker(F.col("line")).alias("line"))
    joined = parted.groupBy("row", "conv", "place", "part", "role").agg(F.sort_array(F.collect_list(entry)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda r: r["line"]), "\n")
    return joined.select("conv", "place", "part", "role", text.alias("text"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>"))
