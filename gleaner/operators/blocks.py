"""Ranks of very many scored rows: rows of one key travel and are sorted as arrays, not row by row.

Rows are packed where they are made into blocks (keys, ids, scores), each in order and of one key. The blocks are
checkpointed, so what follows is fixed. Bounds drawn from the blocks cut the rows of a large key into runs of about
RUN_ROWS, equal scores too, so that no key has to fit one task; Spark brings the pieces of a run together, and a task
sorts one run at a time. What the runs in front hold is known before, from the lengths of the pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import broadcast_if_small, cut_lineage

PACK_ROWS = 1 << 19  # rows a task holds before it makes blocks of them
RUN_ROWS = 1 << 19  # rows sorted at once
SAMPLES = 32  # places of a run that its bounds are drawn from
PARTS = 32  # of a key's ids, by their hash, when the places of an id are summed
_FLIP = np.int64(0x7FFFFFFFFFFFFFFF)


def _descending(scores: np.ndarray) -> np.ndarray:
    """Integers whose ascending order is the descending order of the scores, NaN first as Spark has it."""
    bits = np.where(np.isnan(scores), np.nan, scores + 0.0).view(np.int64)
    return ~(bits ^ ((bits >> 63) & _FLIP))


def _scores(order: np.ndarray) -> np.ndarray:
    bits = ~order
    return (bits ^ ((bits >> 63) & _FLIP)).view(np.float64)


def _numbers(ids: pa.Array) -> np.ndarray | None:
    """Ids as numbers, if they are integers and all there."""
    return ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) and not ids.null_count else None


def _sorted_places(ids: pa.Array, order: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
    """Places of the rows by group, order and id, null ids first. A missing order comes last."""
    numbers = _numbers(ids)
    if numbers is not None:
        return np.lexsort((numbers, order) if groups is None else (numbers, order, groups))
    columns = {"o": pa.array(order), "id": ids} if groups is None else {"g": pa.array(groups), "o": pa.array(order), "id": ids}
    by = [(c, "ascending") for c in columns]
    return pc.sort_indices(pa.table(columns), sort_keys=by, null_placement="at_start").to_numpy()


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _groups(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number for each combination of keys."""
    groups = np.zeros(rows.num_rows, dtype=np.int64)
    for key in keys:
        codes = pc.dictionary_encode(_one(rows[key]), null_encoding="encode")
        groups = groups * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False)
    return groups


def _pack(rows: pa.Table, keys: Sequence[str]) -> pa.RecordBatch:
    """A block for each combination of keys."""
    groups = _groups(rows, keys)
    order, ids = _descending(_one(rows["score"]).to_numpy(zero_copy_only=False)), _one(rows["id"])
    places = _sorted_places(ids, order, groups)
    groups = groups[places]
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    cuts = pa.array(np.append(starts, len(groups)), pa.int32())
    first = pa.array(places[starts])
    return pa.RecordBatch.from_arrays(
        [*[_one(rows[k]).take(first) for k in keys], pa.ListArray.from_arrays(cuts, ids.take(pa.array(places))),
         pa.ListArray.from_arrays(cuts, pa.array(order[places]))],
        names=[*keys, "_ids", "_order"])


def _packer(keys: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield _pack(pa.Table.from_batches(held), keys)
                held, n = [], 0
        if n:
            yield _pack(pa.Table.from_batches(held), keys)

    return pack


def _sampler(keys: list[str], step: int):
    """One row in `step` of each block, from a place that its content decides."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, orders = batch.column("_ids"), batch.column("_order")
            taken = []
            for i in range(batch.num_rows):
                order = orders[i].values.to_numpy()
                seed = zlib.crc32(order.tobytes()) * step >> 32
                taken += [(i, o, x) for o, x in zip(order[seed::step].tolist(), ids[i].values[seed::step].to_pylist(), strict=True)]
            if taken:
                rows = pa.array([t[0] for t in taken])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(rows) for k in keys], pa.array([t[1] for t in taken], pa.int64()),
                     pa.array([t[2] for t in taken], ids.type.value_type)], names=[*keys, "_o", "id"])

    return sample


def _place_after(order: np.ndarray, ids: pa.Array, bound: dict) -> int:
    """How many rows of a block are not behind the bound."""
    low, high = np.searchsorted(order, bound["_o"], "left"), np.searchsorted(order, bound["_o"], "right")
    alike = ids[low:high]
    numbers = _numbers(alike)
    if numbers is not None and bound["id"] is not None:
        return int(low + np.searchsorted(numbers, bound["id"], "right"))
    known = alike.drop_null().to_pylist()  # nulls are in front
    if alike.type in (pa.string(), pa.large_string()):
        known, at = [x.encode() for x in known], bound["id"] and bound["id"].encode()
        at = b"" if bound["id"] == "" else at
    else:
        at = bound["id"]
    return int(low + alike.null_count + (0 if at is None else bisect.bisect_right(known, at)))


def _cutter(keys: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, orders = batch.column("_ids"), batch.column("_order")
            places, rows, runs = [0], [], []
            base = 0
            for i, bounds in enumerate(batch.column("_bounds").to_pylist()):
                order, held = orders[i].values.to_numpy(), ids[i].values
                ends = [_place_after(order, held, b) for b in bounds or ()] + [len(order)]
                last = 0
                for run, end in enumerate(ends):
                    if end > last:
                        places.append(base + end)
                        rows.append(i)
                        runs.append(run)
                        last = end
                base += len(order)
            cuts = pa.array(places, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(pa.array(rows, pa.int64())) for k in keys], pa.array(runs, pa.int32()),
                 pa.array(np.diff(np.array(places)), pa.int64()), pa.ListArray.from_arrays(cuts, ids.flatten()),
                 pa.ListArray.from_arrays(cuts, orders.flatten())], names=[*keys, "_run", "_n", "_ids", "_order"])

    return cut


def _merger(keys: list[str]):
    def merge(table: pa.Table) -> pa.Table:
        ids, order = _one(pc.list_flatten(table["_ids"])), _one(pc.list_flatten(table["_order"])).to_numpy()
        places = _sorted_places(ids, order)
        n, first = len(places), table.slice(0, 1)
        rank = np.arange(1, n + 1) + first["_before"][0].as_py()
        return pa.table([
            *[_one(first[k]).take(pa.array(np.zeros(n, dtype=np.int64))) for k in keys], ids.take(pa.array(places)),
            pa.array(_scores(order[places])), pa.array(rank, pa.int64())], names=[*keys, "id", "score", "rank"])

    return merge


def _alike(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(right[f"_r{c}"])
    return cond


def _looked_up(rows: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    lookup = lookup.select(*[F.col(c).alias(f"_r{c}") for c in on], *[c for c in lookup.columns if c not in on])
    lookup = broadcast_if_small(lookup)
    return rows.join(lookup, _alike(rows, lookup, on), "left").drop(*[f"_r{c}" for c in on])


def _types(rows: DataFrame, keys: Sequence[str]) -> tuple[str, str]:
    """The keys and their types, and the type of the ids."""
    return "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys), rows.schema["id"].dataType.simpleString()


def rank_scores(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, score, rank) of `rows` (keys, id, score): 1, 2, 3… within each key, best score first, then by id."""
    keys = list(keys)
    rows = rows.select(*keys, "id", F.col("score").cast("double").alias("score"))
    key_types, id_type = _types(rows, keys)
    return _rank_blocks(rows.mapInArrow(_packer(keys), f"{key_types}_ids array<{id_type}>, _order array<bigint>"), keys, key_types, id_type)


def _rank_blocks(blocks: DataFrame, keys: list[str], key_types: str, id_type: str) -> DataFrame:
    arrays = f"_ids array<{id_type}>, _order array<bigint>"
    blocks = cut_lineage(blocks)
    step = max(1, RUN_ROWS // SAMPLES)
    large = blocks.groupBy(*keys).agg(F.sum(F.size("_order").cast("bigint")).alias("_all")).filter(F.col("_all") > RUN_ROWS)
    drawn = blocks.mapInArrow(_sampler(keys, step), f"{key_types}_o bigint, id {id_type}")
    drawn = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "id"))).alias("_drawn"))
    bounds = _looked_up(large.select(*keys), drawn, keys).select(
        *keys, F.filter("_drawn", lambda _, i: (i + 1) % SAMPLES == 0).alias("_bounds"))
    pieces = _looked_up(blocks, bounds, keys).mapInArrow(_cutter(keys), f"{key_types}_run int, _n bigint, {arrays}")
    sizes = pieces.groupBy(*keys, "_run").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = _looked_up(pieces.drop("_n"), before, [*keys, "_run"])
    return placed.groupBy(*keys, "_run").applyInArrow(_merger(keys), f"{key_types}id {id_type}, score double, rank bigint")


def _dealer(keys: list[str]):
    """Rows (keys, _part, id, rank) to blocks of one key and part."""

    def deal(rows: pa.Table) -> pa.RecordBatch:
        groups = _groups(rows, keys)
        places = np.argsort(groups, kind="stable")
        groups = groups[places]
        starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        cuts, first, every = pa.array(np.append(starts, len(groups)), pa.int32()), pa.array(places[starts]), pa.array(places)
        return pa.RecordBatch.from_arrays(
            [*[_one(rows[k]).take(first) for k in keys], *[pa.ListArray.from_arrays(cuts, _one(rows[c]).take(every)) for c in ("id", "rank")]],
            names=[*keys, "_ids", "_ranks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield deal(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield deal(pa.Table.from_batches(held))

    return run


def _rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark does it: half up, of the shortest decimal that is the number."""
    scaled = values * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    unsure = np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-3 + 4 * np.spacing(scaled)
    for i in np.flatnonzero(unsure):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _summer(keys: list[str], k: int, digits: int):
    """Blocks in order of (keys, _part) to blocks (keys, _ids, _order), the places of each id summed."""

    def total(blocks: pa.Table) -> pa.RecordBatch:
        groups = _groups(blocks, [*keys, "_part"])
        _, first, groups = np.unique(groups, return_index=True, return_inverse=True)
        lists = _one(blocks["_ids"])
        rows = pa.table({
            "g": pa.array(np.repeat(groups, lists.value_lengths().to_numpy())), "id": lists.flatten(),
            "s": pa.array(1.0 / (k + _one(blocks["_ranks"]).flatten().to_numpy()))})
        found = rows.group_by(["g", "id"], use_threads=False).aggregate([("s", "sum")])
        owner = pa.array(first[_one(found["g"]).to_numpy()])
        return _pack(pa.table(
            [*[_one(blocks[c]).take(owner) for c in keys], _one(found["id"]), pa.array(_rounded(_one(found["s_sum"]).to_numpy(), digits))],
            names=[*keys, "id", "score"]), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            groups = _groups(held, [*keys, "_part"])
            last = int(np.argmax(groups == groups[-1])) if len(groups) else 0  # the last group may go on
            ends = np.flatnonzero(np.append(groups[1 : last + 1] != groups[:last], False)) + 1
            sizes = np.cumsum(pc.list_value_length(_one(held["_ids"])).to_numpy())
            begin = 0
            for i, end in enumerate(ends):
                upto = sizes[ends[i + 1] - 1] if i + 1 < len(ends) else np.inf
                if upto - (sizes[begin - 1] if begin else 0) > PACK_ROWS:
                    yield total(held.slice(begin, end - begin))
                    begin = int(end)
            held = held.slice(begin)
        if held is not None and held.num_rows:
            yield total(held)

    return run


def rank_sums(rankings: DataFrame, keys: Sequence[str], k: int, digits: int) -> DataFrame:
    """(keys, id, score, rank) by the sum of 1/(k + rank) over all rows (keys, id, rank) of an id, rounded to `digits`.

    The rows of a key travel in blocks too, in parts by the hash of their id, and are summed part by part.
    """
    keys = list(keys)
    rows = rankings.filter(F.col("rank").isNotNull()).select(
        *keys, F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("_part"), "id", F.col("rank").cast("bigint").alias("rank"))
    key_types, id_type = _types(rows, keys)
    dealt = rows.mapInArrow(_dealer([*keys, "_part"]), f"{key_types}_part int, _ids array<{id_type}>, _ranks array<bigint>")
    together = dealt.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part")
    blocks = together.mapInArrow(_summer(keys, k, digits), f"{key_types}_ids array<{id_type}>, _order array<bigint>")
    return _rank_blocks(blocks, keys, key_types, id_type)
