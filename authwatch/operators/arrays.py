"""Window measures and prior state of users with short histories, as arrays over sorted rows.

One shuffle on the user and one sort serve the kinds ``user``, ``pair`` and ``user_device``: a task reads its sorted rows
as Arrow batches that end between two users and finds every window by binary search, every sum as a difference of two
running sums. That is linear in the events but for the search, and no wide row enters a window operator of Spark.
It holds the events of one user at a time, so dense users go another way, see ``plans.features``.

Only accumulators and state are found here; published values are the SQL of ``histories`` and ``sequences``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FeatureConfig, micros
from ..schema import DIMENSION_COLUMNS, ENTITY_KEYS, Feature
from .histories import US, _accumulators, _finish, _row_value
from .sequences import _FAILED, _HERE, _OK, INPUTS, _published, _state

# Rows that state is taken from, as SQL; a verdict that is null is false.
_MARKS = {"__failed": f"{_FAILED} = 1", "__other": "authentication_outcome != 'failure'", "__ok": _OK, "__ok_here": f"{_OK} AND {_HERE}"}
_NTH = "__nth"
_SUCCESS, _LOCATED = ("country_code", "region_code"), (US, "coarse_latitude", "coarse_longitude")


def array_features(
    df: DataFrame, wanted: dict[str, tuple[list[Feature], set[str]]], config: FeatureConfig, kept: list[str],
    bucket: str | None = None,
) -> DataFrame:
    """The columns ``kept`` and each kind's features and sequences, ``wanted`` = {kind under the user: (features, sequences)}.

    ``df`` is dealt out by its column ``bucket``, a function of the user, if there is one; else it is dealt out here, by user.
    """
    types = {f.name: f.dataType for f in df.schema}
    plan, inputs, fields = [], {"user_id", US}, []
    sums: set[str] = set()
    for kind, (features, sequences) in wanted.items():
        needed = {w: sorted(names) for w, names in _accumulators(features).items()}
        everything = {n for names in needed.values() for n in names}
        dims = {n: DIMENSION_COLUMNS[n] for n in sorted(everything) if n in DIMENSION_COLUMNS}
        sums |= {n for n in everything if n not in dims and not n.startswith("gap")}
        states = list(_state(sequences))
        second = ENTITY_KEYS[kind][1] if len(ENTITY_KEYS[kind]) > 1 else None
        inputs |= {*dims.values(), *([second] if second else []), *(INPUTS if states else ())}
        plan.append((kind, second, [(w, micros(w), names) for w, names in needed.items()], dims, states))
        fields += [T.StructField(f"__{kind}__{n}__{w}", T.LongType()) for w, names in needed.items() for n in names]
        struct = {"__last": ("authentication_outcome",), "__success": _SUCCESS, "__located": _LOCATED}
        fields += [T.StructField(f"__{kind}{s}", T.StructType([T.StructField(c, types[c]) for c in struct[s]]) if s in struct else T.LongType())
                   for s in states]
    stateful = any(states for *_, states in plan)
    if stateful:
        inputs.add("event_id")
    # Tied events are told apart by their id, repeats of an id by the values that state is made of.
    order = ["user_id", US, *(["event_id", *INPUTS] if stateful else [])]
    if bucket is None:
        rows = df.repartition("user_id")
    else:
        # The number is not read. It obliges Spark to keep users whole whatever it makes of the joins that ``df`` comes from, and needs the
        # order of the rows below, so that nothing is dealt out or sorted for it.
        over = f"OVER (PARTITION BY {bucket}, user_id ORDER BY {', '.join(order[1:])})"
        rows, order = df.withColumn(_NTH, F.expr(f"row_number() {over}")), [bucket, *order]
        inputs.add(_NTH)
    rows = rows.selectExpr(
        *dict.fromkeys([*kept, *sorted(inputs), *([bucket] if bucket else [])]), *[f"{_row_value(n)} AS __v_{n}" for n in sorted(sums)],
        *([f"coalesce({e}, false) AS {n}" for n, e in _MARKS.items()] if stateful else [])).sortWithinPartitions(*order)
    schema = T.StructType([*[T.StructField(c, types[c]) for c in kept], *fields])
    out, done = rows.mapInArrow(_measurer(kept, plan, [f.name for f in fields]), schema), list(kept)
    for kind, (features, sequences) in wanted.items():
        mine = f"__{kind}__"
        state = [f"`{f.name}` AS `{f.name[len(mine) - 2:]}`" for f in fields if f.name.startswith(mine)]
        later = [f"`{f.name}`" for f in fields if f.name in out.columns and not f.name.startswith(mine)]
        values = [f"{_finish(f, config)} AS {f.name}" for f in features]
        values += [f"{v} AS {n}" for n, v in _published(sequences, config).items()]
        out = out.selectExpr(*[f"`{c}`" for c in done], *later, *state).selectExpr(*[f"`{c}`" for c in done], *later, *values)
        done += [c for c in out.columns if c not in done and not c.startswith("__")]
    return out


def _measurer(kept: list[str], plan: list[tuple], names: list[str], least_rows: int = 20_000):
    """Accumulators and state over rows sorted by user, time and id, for batches of whole users.

    ``plan`` has for each kind its second key, its windows with their accumulators, its dimensions and its states.
    """
    time, none = US, -(1 << 62)
    success, located = _SUCCESS, _LOCATED

    def codes(rows: pa.Table, name: str) -> np.ndarray:
        """Whole numbers that are equal where values are, nulls being equal."""
        column = rows.column(name).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)

    def running(values: np.ndarray) -> np.ndarray:
        """Sums of the rows before each position; differences are right even where these wrap around."""
        out = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=out[1:])
        return out

    def changes(values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        out[1:] = values[1:] != values[:-1]
        return out

    def measure(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        n = rows.num_rows
        at = np.arange(n)
        us_in = pc.fill_null(rows.column(time), none).to_numpy()
        ticks, tick = np.unique(us_in, return_inverse=True)
        span = len(ticks) + 1
        user = np.cumsum(changes(codes(rows, "user_id"))) - 1
        found = {}
        for kind, second, windows, dims, states in plan:
            key, order = user, at
            if second is not None:
                other = codes(rows, second)
                key = user * (other.max() + 1) + other
                order = np.argsort(key, kind="stable")
                key = key[order]
            back = np.empty(n, np.int64)
            back[order] = at
            us, new = us_in[order], changes(key)
            group = np.cumsum(new) - 1
            begin = np.maximum.accumulate(np.where(new, at, 0))
            first = new | changes(us)
            # Rows of the group that are strictly earlier end here; rows without a time count as earlier than each other.
            end = np.maximum.accumulate(np.where(first, at, 0))
            if us_in.min() == none:
                marks = np.flatnonzero(first)
                after = np.append(marks[1:], n)
                end = np.where(us == none, np.repeat(after, after - marks), end)
            place = group * span + tick[order]
            earlier = end > begin

            def value(name: str) -> np.ndarray:
                return rows.column(name).to_numpy()[order]

            def put(name: str, values: np.ndarray, null: np.ndarray | None = None) -> None:
                found[f"__{kind}{name}"] = pa.array(values[back], mask=None if null is None else null[back])

            def last(which: np.ndarray) -> np.ndarray:
                """The last marked row of the group that is strictly earlier, else -1."""
                seen = np.maximum.accumulate(np.where(which, at, -1))[end - 1]
                return np.where(earlier & (seen >= begin), seen, -1)

            def mark(name: str) -> np.ndarray:
                return rows.column(name).to_numpy()[order].astype(bool)

            def fields_of(row: np.ndarray, columns: tuple[str, ...], source: np.ndarray = order) -> pa.StructArray:
                row = row[back]
                take = pa.array(source[row], mask=row < 0)
                parts = [rows.column(c).combine_chunks() for c in columns]
                parts = [p.chunk(0) if isinstance(p, pa.ChunkedArray) else p for p in parts]
                return pa.StructArray.from_arrays([p.take(take) for p in parts], list(columns), mask=pa.array(row < 0))

            twins = {}
            for name, column in dims.items():
                x = codes(rows, column)[order]
                known = rows.column(column).is_valid().to_numpy()[order]
                same = group * (x.max() + 1) + x
                by = np.argsort(same, kind="stable")
                by = by[known[by]]
                joined = same[by][1:] == same[by][:-1]
                twins[name] = by, joined, us[by][1:] - us[by][:-1]
            gap = np.zeros(n, np.int64)
            gap[1:] = np.where(new[1:] | (us[:-1] == none), 0, us[1:] - us[:-1])
            squares = {"gap_hh": (gap >> 16) * (gap >> 16), "gap_hl": (gap >> 16) * (gap & 65535), "gap_ll": (gap & 65535) * (gap & 65535)}
            for window, w_us, accumulators in windows:
                start = np.searchsorted(place, group * span + np.searchsorted(ticks, us - w_us))
                some = end > start
                for name in accumulators:
                    null = None
                    if name in dims:
                        # A value enters with an occurrence that has none shortly before it, and leaves after one with none shortly after.
                        by, joined, apart = twins[name]
                        close = joined & (apart <= w_us)
                        enters, leaves = np.zeros(n, np.int64), np.zeros(n, np.int64)
                        enters[by], leaves[by] = 1, 1
                        enters[by[1:][close]], leaves[by[:-1][close]] = 0, 0
                        enters, leaves = running(enters), running(leaves)
                        values = enters[end] - enters[begin] - (leaves[start] - leaves[begin])
                    elif name == "gap_sum":
                        values, null = us[end - 1] - us[np.minimum(start, n - 1)], ~some | (us == none)
                    elif name in squares:
                        # The oldest event's own gap crosses the left edge.
                        total = running(squares[name])
                        values = np.where(some, total[end] - total[np.minimum(start + 1, n)], 0)
                    else:
                        total = running(value(f"__v_{name}"))
                        values = total[end] - total[start]
                    put(f"__{name}__{window}", values, null)
            if "__fails" in states:
                fails = running(mark("__failed"))
                put("__fails", fails[end] - fails[begin])
                upto = fails[1:] - fails[begin]
            for name in states:
                if name in ("__cf_reset", "__cf_success"):
                    row = last(mark("__other" if name == "__cf_reset" else "__ok"))
                    put(name, upto[row], row < 0)
                elif name in ("__last_us", "__last_success_us", "__last_failure_us"):
                    # rows without a time have none to offer
                    which = us != none
                    if name != "__last_us":
                        which &= mark("__ok" if name == "__last_success_us" else "__failed")
                    row = last(which)
                    put(name, us[row], row < 0)
                elif name == "__last":
                    found[f"__{kind}__last"] = fields_of(np.where(earlier, end - 1, -1), ("authentication_outcome",))
                elif name == "__success":
                    found[f"__{kind}__success"] = fields_of(last(mark("__ok")), success)
                elif name == "__located":
                    # Repeats of an id at one time: the greatest place is the last one.
                    ids = first | changes(codes(rows, "event_id")[order])
                    source, here = order, mark("__ok_here")
                    if not ids.all():
                        again = np.lexsort((value("coarse_longitude"), value("coarse_latitude"), np.cumsum(ids)))
                        source, here = order[again], here[again]
                    found[f"__{kind}__located"] = fields_of(last(here), located, source)
        arrays = [rows.column(c).combine_chunks() for c in kept]
        arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        return pa.RecordBatch.from_arrays([*arrays, *[found[c] for c in names]], names=[*kept, *names])

    def run(batches):
        held, n, enough = [], 0, least_rows
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= enough:
                rows = pa.Table.from_batches(held)
                ends = np.flatnonzero(changes(codes(rows, "user_id")))
                cut = int(ends[-1])
                if cut:
                    yield measure(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), len(rows) - cut
                enough = max(least_rows, 2 * n)
        if held:
            yield measure(pa.Table.from_batches(held))

    return run
