"""Point-in-time window measures of one entity kind, in two exact physical forms.

``frame`` form: sliding RANGE frames ``[t - w, t - 1us]``.  Cheap while a frame
holds few rows.  ``sweep`` form: every contribution becomes a pair of deltas on
the time axis and a running sum, so cost is linear in the number of events
however full a window is; a chunk of one key is summed as arrays, and totals are
carried from chunk to chunk, so one task never holds a whole key.
``plans.features`` routes dense entities to the sweep form.

Expressions are SQL text: one parse per column instead of one JVM call per node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig, micros
from ..functions.scalar import bucket
from ..runtime import cut_lineage
from ..schema import DIMENSION_COLUMNS, ENTITY_KEYS, Feature
from .prefix import CHUNK, LONG, neighbours, with_chunk

US = "event_us"
# Stand-in for "no earlier event": further away than any window.
_NEVER = -(1 << 61)

_OUTCOME_OF = {
    "success_count": "success",
    "failure_count": "failure",
    "blocked_count": "blocked",
    "challenge_count": "challenged",
}


# A squared gap overflows bigint, so gap = hi * 2^16 + lo and three bigint sums are kept;
# inside a window of w microseconds each of them stays below 2^16 * w.
_SQUARES = {
    "gap_hh": "shiftright({g}, 16) * shiftright({g}, 16)",
    "gap_hl": "shiftright({g}, 16) * ({g} & 65535L)",
    "gap_ll": "({g} & 65535L) * ({g} & 65535L)",
}


def _gap_sumsq(acc) -> str:
    wide = "cast({} as decimal(38,0))"
    hh, hl, ll = (wide.format(acc(n)) for n in _SQUARES)
    return f"({hh} * 4294967296BD + {hl} * 131072BD + {ll})"


def sample_std(n: str, total: str, total_sq: str) -> str:
    """Sample standard deviation from exact integer sums; null below two observations."""
    n38, s38, q38 = (f"cast({c} as decimal(38,0))" for c in (n, total, total_sq))
    numerator = f"cast({n38} * {q38} - {s38} * {s38} as double)"
    return f"CASE WHEN {n} >= 2 THEN sqrt({numerator} / cast({n} * ({n} - 1) as double)) END"


def _needs(measure: str) -> set[str]:
    """Accumulators a measure is computed from."""
    if measure in DIMENSION_COLUMNS:
        return {measure}
    if measure in _OUTCOME_OF:
        return {_OUTCOME_OF[measure]}
    return {
        "attempt_count": {"n"}, "event_count": {"n"},
        "mfa_failure_count": {"mfa_failed"},
        "failure_rate": {"n", "failure"}, "success_rate": {"n", "success"},
        "mean_response_time_ms": {"rt_n", "rt_sum"},
        "response_time_std_ms": {"rt_n", "rt_sum", "rt_sumsq"},
        "mean_interarrival_seconds": {"n", "gap_sum"},
        "interarrival_std_seconds": {"n", "gap_sum", *_SQUARES},
        "interarrival_coefficient_of_variation": {"n", "gap_sum", *_SQUARES},
    }[measure]


def _finish(feature: Feature, config: FeatureConfig) -> str:
    """Turn the accumulator columns of the feature's window into the published value."""
    def acc(name: str) -> str:
        return f"__{name}__{feature.window}"

    measure = feature.measure
    if measure in DIMENSION_COLUMNS or measure in _OUTCOME_OF:
        return f"cast({acc(_OUTCOME_OF.get(measure, measure))} as bigint)"
    if measure in ("attempt_count", "event_count"):
        return f"cast({acc('n')} as bigint)"
    if measure == "mfa_failure_count":
        return f"cast({acc('mfa_failed')} as bigint)"
    if measure in ("failure_rate", "success_rate"):
        floor = max(1, config.min_count_for_rate)
        return f"CASE WHEN {acc('n')} >= {floor} THEN {acc(measure.split('_')[0])} / {acc('n')} END"
    if measure == "mean_response_time_ms":
        return f"CASE WHEN {acc('rt_n')} > 0 THEN {acc('rt_sum')} / {acc('rt_n')} END"
    if measure == "response_time_std_ms":
        return sample_std(acc("rt_n"), acc("rt_sum"), acc("rt_sumsq"))
    gaps = f"({acc('n')} - 1)"
    mean = f"(CASE WHEN {gaps} > 0 THEN {acc('gap_sum')} / {gaps} / 1e6D END)"
    if measure == "mean_interarrival_seconds":
        return mean
    std = f"({sample_std(gaps, acc('gap_sum'), _gap_sumsq(acc))}) / 1e6D"
    if measure == "interarrival_std_seconds":
        return std
    return f"CASE WHEN {mean} != 0 THEN {std} / {mean} END"


def derived(feature: Feature, config: FeatureConfig, names: set[str]) -> str | None:
    """SQL of the published value from other published columns of its kind and window, if all of them are in ``names``; the same to the last bit."""
    def column(measure: str) -> str:
        return f"{feature.kind}_{measure}__{feature.window}"

    if feature.measure in ("failure_rate", "success_rate"):
        some, all_ = column(feature.measure.replace("rate", "count")), column("attempt_count")
        if {some, all_} <= names:
            return f"CASE WHEN {all_} >= {max(1, config.min_count_for_rate)} THEN {some} / {all_} END"
    if feature.measure == "interarrival_coefficient_of_variation":
        std, mean = column("interarrival_std_seconds"), column("mean_interarrival_seconds")
        if {std, mean} <= names:
            return f"CASE WHEN {mean} != 0 THEN {std} / {mean} END"
    return None


def _row_value(name: str) -> str:
    """Contribution of one event to an additive accumulator."""
    if name == "n":
        return "1L"
    if name == "mfa_failed":
        return "CASE WHEN mfa_outcome = 'failed' THEN 1L ELSE 0L END"
    if name == "rt_n":
        return "CASE WHEN response_time_ms IS NOT NULL THEN 1L ELSE 0L END"
    if name == "rt_sum":
        return "coalesce(response_time_ms, 0L)"
    if name == "rt_sumsq":
        return "coalesce(response_time_ms * response_time_ms, 0L)"
    return f"CASE WHEN authentication_outcome = '{name}' THEN 1L ELSE 0L END"


def _accumulators(features: list[Feature]) -> dict[str, set[str]]:
    needed: dict[str, set[str]] = {}
    for feature in features:
        needed.setdefault(feature.window, set()).update(_needs(feature.measure))
    return needed


def frame_features(
    df: DataFrame, kind: str, features: list[Feature], config: FeatureConfig, keys: list[str]
) -> DataFrame:
    """Sliding-frame form over the given partition columns."""
    partition = f"PARTITION BY {', '.join(keys)} ORDER BY {US}"
    needed = _accumulators(features)
    rows = df
    if any("gap_hh" in names for names in needed.values()):
        # Tied rows may take any order here: one of them owns the gap, the others have gap 0.
        rows = rows.selectExpr(
            "*",
            f"{US} - lag({US}) OVER ({partition}) AS __gap",
            f"coalesce(max({US}) OVER ({partition} RANGE BETWEEN UNBOUNDED PRECEDING AND 1L PRECEDING), "
            f"{_NEVER}L) AS __prev",
        )
    columns: list[str] = []
    for window, names in needed.items():
        w_us = micros(window)
        over = f"OVER ({partition} RANGE BETWEEN {w_us}L PRECEDING AND 1L PRECEDING)"
        for name in sorted(names):
            if name in DIMENSION_COLUMNS:
                value = f"size(collect_set({DIMENSION_COLUMNS[name]}) {over})"
            elif name == "gap_sum":
                value = f"max({US}) {over} - min({US}) {over}"
            elif name in _SQUARES:
                # The oldest event's own gap crosses the left edge, so it is taken out again.
                inside = f"CASE WHEN __gap <= {w_us}L THEN {_SQUARES[name].format(g='__gap')} END"
                crossing = f"(min({US}) {over} - min(__prev) {over})"
                first = f"CASE WHEN {crossing} <= {w_us}L THEN {_SQUARES[name].format(g=crossing)} END"
                value = f"coalesce(sum({inside}) {over}, 0L) - coalesce({first}, 0L)"
            else:
                value = f"coalesce(sum({_row_value(name)}) {over}, 0L)"
            columns.append(f"{value} AS __{name}__{window}")
    rows = rows.selectExpr("*", *columns)
    finished = [f"{_finish(f, config)} AS {f.name}" for f in features]
    return rows.selectExpr(*df.columns, *finished)


#: Thin rows of a sweep that one task sorts, whatever the size of the table.
SWEEP_ROWS = 1_000_000


def sweep_features(
    df: DataFrame, kind: str, features: list[Feature], config: FeatureConfig, row: str = "event_id", short: frozenset[str] = frozenset()
) -> DataFrame:
    """Sweep-line form; returns (row, features...) for the given events, ``row`` being a column that tells them apart.

    ``short`` names columns none of whose values is known to have many events.
    """
    keys = list(ENTITY_KEYS[kind])
    width = micros(config.skew.chunk)
    needed = _accumulators(features)
    windows = sorted(needed, key=micros)
    everything = {n for names in needed.values() for n in names}
    dims = sorted(everything & set(DIMENSION_COLUMNS))
    additive = sorted(n for n in everything - set(dims) if not n.startswith("gap"))

    base_columns = list(dict.fromkeys(
        [row, US, *keys, "authentication_outcome", "mfa_outcome", "response_time_ms",
         *[DIMENSION_COLUMNS[d] for d in dims]]
    ))
    if LONG not in df.columns:
        df = df.withColumn(LONG, F.lit(True))
    events = with_chunk(df.select(*base_columns, LONG), US, width)

    # Thin delta rows: when a change takes effect, which window it belongs to (-1 = all),
    # what it is (-1 = an event with its payload, else a dimension) and with which sign.  An event
    # row brings the gap to its predecessor, its expiry row takes out the gap to its successor.
    row_type = df.schema[row].dataType.simpleString()

    plain, gaps = events, "gap_sum" in everything
    if gaps:
        events = neighbours(events, keys, US, "prev_us", "next_us")
    before, after = (f"coalesce({US} - prev_us, 0L)", f"coalesce(next_us - {US}, 0L)") if gaps else ("0L", "0L")
    changes = [f"named_struct('at', {US}, 'slot', -1, 'sign', 1L, 'gap', {before}, 'event', {row})"]
    if additive:
        changes += [
            f"named_struct('at', {US} + {micros(w)}L, 'slot', {i}, 'sign', -1L, 'gap', {after}, 'event', cast(null as {row_type}))"
            for i, w in enumerate(windows) if needed[w] & set(additive)]
    deltas = events.selectExpr("*", f"explode(array({', '.join(changes)})) AS e").selectExpr(
        f"e.event AS {row}", *keys, LONG, f"e.at AS {US}", "e.slot AS slot", "-1 AS what", "e.sign AS sign", "e.gap AS gap",
        *[f"{_row_value(n)} AS v_{n}" for n in additive])
    if dims:
        # Distinct counting: +1 when a value appears in a window, -1 when its last
        # occurrence leaves it.  Occurrences closer than the window cancel, so a
        # value that keeps repeating costs nothing: of those inside a step no longer
        # than any window, only the first and the last are kept.
        counted = [(i, micros(w)) for i, w in enumerate(windows) if needed[w] & set(dims)]
        step = min(width, *[w_us for _, w_us in counted])
        order = f"OVER (PARTITION BY {', '.join(keys)}, what, x ORDER BY step)"
        edges = ["CASE WHEN prev_us IS NULL THEN named_struct('at', first_us, 'slot', -1, 'sign', 1L) END"]
        for i, w_us in counted:
            gone = f"CASE WHEN next_us IS NULL OR next_us - last_us > {w_us}L THEN named_struct('at', {{}}, 'slot', {i}, 'sign', {{}}) END"
            edges += [gone.format(f"last_us + {w_us}L", "-1L"), gone.format("next_us", "1L")]
        # Values with short histories hardly repeat inside a step, so they are dealt out once and merged there; the others are merged before
        # they are dealt out, and again for their order.
        for once in (True, False):
            entries = ", ".join(f"named_struct('what', {i}, 'x', cast({DIMENSION_COLUMNS[d]} as string))"
                                for i, d in enumerate(dims) if (DIMENSION_COLUMNS[d] in short) == once)
            if not entries:
                continue
            seen = plain.selectExpr(*keys, LONG, US, f"inline(array({entries}))").where("x IS NOT NULL")
            if once:
                seen = seen.repartition(*keys, "what", "x")
            seen = seen.groupBy(*keys, LONG, "what", "x", bucket(F.col(US), step).alias("step")).agg(
                F.min(US).alias("first_us"), F.max(US).alias("last_us"))
            seen = seen.selectExpr("*", f"lag(last_us) {order} AS prev_us", f"lead(first_us) {order} AS next_us")
            deltas = deltas.unionByName(
                seen.selectExpr("*", f"explode(array({', '.join(edges)})) AS c").where("c.at IS NOT NULL").selectExpr(
                    f"cast(null as {row_type}) AS {row}", *keys, LONG, f"c.at AS {US}", "c.slot AS slot", "what", "c.sign AS sign",
                    "0L AS gap", *[f"0L AS v_{n}" for n in additive]))
    # Read twice, so the thin rows are stored; the wide per-window sums exist only for rows that are returned. The number of
    # tasks follows the rows: adaptive execution would join partitions by their compressed size, which says little about thin rows.
    deltas = cut_lineage(with_chunk(deltas, US, width).drop(LONG))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, deltas.count() // SWEEP_ROWS + 1)

    sums: list[tuple[int, int, str, str]] = []  # window, its width, accumulator, SQL of a row's contribution
    for i, window in enumerate(windows):
        w_us = micros(window)
        for name in sorted(needed[window]):
            if name in DIMENSION_COLUMNS:
                expr = f"CASE WHEN slot IN (-1, {i}) AND what = {dims.index(name)} THEN sign ELSE 0L END"
            elif name == "gap_sum" or name in _SQUARES:
                value = "gap" if name == "gap_sum" else _SQUARES[name].format(g="gap")
                expr = (f"CASE WHEN slot IN (-1, {i}) AND what = -1 AND gap <= {w_us}L "
                        f"THEN sign * ({value}) ELSE 0L END")
            else:
                expr = f"CASE WHEN slot IN (-1, {i}) AND what = -1 THEN sign * v_{name} ELSE 0L END"
            sums.append((i, w_us, name, expr))
    names = [f"__{name}__{windows[i]}" for i, _, name, _ in sums]
    # State at the start of each chunk: the sums over all earlier chunks of the key.
    totals = deltas.groupBy(*keys, CHUNK).agg(*[F.expr(f"sum({s[3]})").alias(n) for n, s in zip(names, sums)])
    earlier = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = ", ".join(f"coalesce(sum({n}) {earlier}, 0L)" for n in names)
    # One row ahead of each chunk of a key brings that state as a text, and so marks where the chunk begins. (Not as an array:
    # while Spark fills an Arrow batch, each row without one costs a pass over all rows since the last that has one.)
    carried = totals.selectExpr(
        f"cast(null as {row_type}) AS {row}", *keys, f"{CHUNK} * {width}L - 1L AS {US}", "-1 AS slot", "-1 AS what", "0L AS sign",
        "0L AS gap", *[f"0L AS v_{n}" for n in additive], CHUNK, f"concat_ws(',', {carry}) AS carry")
    lines = deltas.withColumn("carry", F.lit(None).cast("string")).unionByName(carried)
    lines = lines.repartition(tasks, *keys, CHUNK).sortWithinPartitions(*keys, CHUNK, F.col("carry").isNull(), US)
    plan = [(i, w_us, dims.index(name) if name in dims else -1, name) for i, w_us, name, _ in sums]
    swept = lines.drop(*keys, CHUNK).mapInArrow(
        _sweeper(row, names, plan), f"{row} {row_type}, " + ", ".join(f"{n} bigint" for n in names))
    return swept.selectExpr(row, *[f"{_finish(f, config)} AS {f.name}" for f in features])


def _sweeper(row: str, names: list[str], plan: list[tuple[int, int, int, str]], least_rows: int = 20_000):
    """Sums before each event over sorted thin rows: cumulative arrays over batches that end between two instants.

    ``plan`` has for each sum its window, the window's width, the dimension (-1: none) and the accumulator.
    """
    time, none = US, -(1 << 63)

    def block(rows: pa.Table, state: np.ndarray, last: bool) -> tuple[pa.RecordBatch | None, np.ndarray, pa.Table]:
        """Sums for whole instants, the sums after them, and the rows of an instant that may go on."""
        us = pc.fill_null(rows.column(time), none).to_numpy()
        starts = rows.column("carry").is_valid().to_numpy()
        first = np.ones(len(us), bool)
        first[1:] = starts[1:] | starts[:-1] | (us[1:] != us[:-1])
        end = len(us) if last else int(np.flatnonzero(first)[-1])
        rest, rows, starts, first = rows.slice(end), rows.slice(0, end), starts[:end], first[:end]
        if not end:
            return None, state, rest
        at = np.arange(end)
        instant = np.maximum.accumulate(np.where(first, at, 0))
        group = np.maximum.accumulate(np.where(starts, at, -1))
        ids = rows.column(row).combine_chunks()
        events = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
        instant, own, final = instant[events], group[events], int(group[-1])
        marks = np.flatnonzero(starts)
        texts = rows.column("carry").drop_null().to_pylist()
        carry = np.array([t.split(",") for t in texts]).astype(np.int64).reshape(len(marks), len(names))

        def values(name: str) -> np.ndarray:
            return rows.column(name).to_numpy()

        slot, what, sign, gap = (values(c) for c in ("slot", "what", "sign", "gap"))
        payload = {"gap_sum": gap, "gap_hh": (gap >> 16) * (gap >> 16), "gap_hl": (gap >> 16) * (gap & 65535),
                   "gap_ll": (gap & 65535) * (gap & 65535)}
        signed, inside, out, after = {}, {}, [ids.take(pa.array(events))], np.zeros_like(state)
        for j, (i, w_us, dim, name) in enumerate(plan):
            narrow = name.startswith("gap_")
            which = (i, dim, narrow)
            if which not in inside:
                hit = ((slot == -1) | (slot == i)) & (what == dim)
                inside[which] = hit & (gap <= w_us) if narrow else hit
            if name not in signed:
                signed[name] = sign if dim >= 0 else sign * (payload[name] if narrow else values(f"v_{name}"))
            change = signed[name] * inside[which]
            change[marks] = carry[:, j]
            before = np.zeros(end + 1, np.int64)
            np.cumsum(change, out=before[1:])
            out.append(pa.array(before[instant] + np.where(own >= 0, -before[own], state[j])))
            after[j] = before[end] + (-before[final] if final >= 0 else state[j])
        return pa.RecordBatch.from_arrays(out, names=[row, *names]), after, rest

    def sweep(batches):
        state, held, n = np.zeros(len(names), np.int64), [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= least_rows:
                found, state, rest = block(pa.concat_tables(held), state, False)
                held, n = [rest], 0
                if found is not None:
                    yield found
        rows = pa.concat_tables(held) if held else None
        if rows is not None and rows.num_rows:
            yield block(rows, state, True)[0]

    return sweep
