"""Ordered scans that stay distributed when one key holds most of the rows.

A plain window sends every row of a key to one task. Here the order axis of a
key is cut into chunks (time slots or value slots). The window runs inside
(key, chunk); one summary row per chunk is scanned over the key, and the state
carried in from earlier chunks is joined back. The result equals the plain
window exactly: chunks only split the work, they never cut rows.

Several definitions (gaps, lags, leads, sums) over one order share one layout: one
shuffle of the rows, one window pass, one summary, one join (``scan_all``).

A row without a key or without a place on the order axis has nothing before or
after it. It goes along in the same branch, in a chunk chosen by a hash of the row,
and its results are NULL. No row is lost, and none is read twice for it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import col, epoch_micros, flag, row_hash

CHUNK = "__chunk"
KNOWN = "__known"
#: Chunks that rows without a place are spread over.
SPREAD = 1 << 12


def time_chunk(ts: Column | str, seconds: int) -> Column:
    """Slot number of a timestamp; monotone in time."""
    return F.floor(F.unix_seconds(col(ts).cast("timestamp")) / F.lit(seconds)).cast("bigint")


@dataclass(frozen=True)
class Definition:
    """What a scan computes, in the two levels.

    inner   columns computed over the rows of one (key, chunk), given that window;
            later entries may use earlier ones
    summary aggregates of one (key, chunk)
    carry   columns over the chunk summaries of a key, given a window ordered by chunk;
            later entries may use earlier ones
    result  final columns out of the row, its inner columns and the carried ones

    Names must differ between definitions that share a scan.
    """

    inner: Mapping[str, Callable] = field(default_factory=dict)
    summary: Mapping[str, Column] = field(default_factory=dict)
    carry: Mapping[str, Callable] = field(default_factory=dict)
    result: Mapping[str, Column] = field(default_factory=dict)


def some_value(kind: T.DataType) -> Column:
    """A value of a type, to stand for NULL beside a flag that says so."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    return (F.lit(0) if isinstance(kind, T.NumericType) else F.lit("false") if isinstance(kind, T.BooleanType) else F.lit("")).cast(kind)


def scan_all(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, definitions: Sequence[Definition], once: bool = False) -> DataFrame:
    """Two-level window: all ``definitions`` over one layout of the rows.

    The rows are shuffled by (key, chunk) and read a second time for the summaries, with the few columns that these need. With ``once`` both
    read the same shuffle, so the source is read once; right where ``df`` has no columns but those that are used, since all of them then go to both.
    """
    merged = {part: {} for part in ("inner", "summary", "carry", "result")}
    for d in definitions:
        for part, names in merged.items():
            more = getattr(d, part)
            if clash := names.keys() & more.keys():
                raise ValueError(f"two definitions have the name {sorted(clash)[0]}")
            names.update(more)
    known = F.col(CHUNK).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    whole = row_hash(df)
    d = df.withColumn(CHUNK, chunk).withColumn(KNOWN, known)
    d = d.withColumn(CHUNK, F.coalesce(F.when(F.col(KNOWN), F.col(CHUNK)), whole.bitwiseAND(F.lit(SPREAD - 1).cast("bigint"))))
    # Keys without NULL: a join by them asks neither side for a filter, which would make the branches differ.
    d = d.withColumns({f"__key_{k}": F.coalesce(k, some_value(df.schema[k].dataType)) for k in keys})
    key_names = [f"__key_{k}" for k in keys]
    place = [*key_names, KNOWN, CHUNK]
    row_window = Window.partitionBy(*place).orderBy(*order)
    for name, make in merged["inner"].items():
        d = d.withColumn(name, make(row_window))
    chunk_window = Window.partitionBy(*key_names, KNOWN).orderBy(CHUNK)
    s = d.groupBy(*place).agg(*[a.alias(n) for n, a in merged["summary"].items()], *([F.max(whole).alias("__whole")] if once else []))
    if once:
        # Always true. It makes both branches of the plan ask for the same columns, and Spark reuse one shuffle.
        s = s.filter(F.col("__whole").isNotNull())
    for name, make in merged["carry"].items():
        s = s.withColumn(name, make(chunk_window))
    s = s.select(*place, *merged["carry"])
    return d.join(s, place).select(*df.columns, *[F.when(F.col(KNOWN), c).alias(n) for n, c in merged["result"].items()])


def backwards(keys: Sequence[str], order: Sequence[Column]) -> Window:
    """Window over the rows of one (key, chunk) in another order, for the inner columns of a scan."""
    return Window.partitionBy(*[f"__key_{k}" for k in keys], KNOWN, CHUNK).orderBy(*order)


def chunks_backwards(keys: Sequence[str]) -> Window:
    """Window over the chunks of a key from the last one, for carried columns."""
    return Window.partitionBy(*[f"__key_{k}" for k in keys], KNOWN).orderBy(F.col(CHUNK).desc())


def chunked_scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, inner: Mapping[str, Callable], summary: Mapping[str, Column],
                 carry: Mapping[str, Callable], result: Mapping[str, Column]) -> DataFrame:
    """A scan with one definition."""
    return scan_all(df, keys, order, chunk, [Definition(inner, summary, carry, result)])


def upto(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def previous(order_by: Sequence[str], take: Mapping[str, str], tag: str = "p") -> Definition:
    """The previous row's values: ``take`` maps new name -> source column."""
    payload = F.struct(*[F.col(src).alias(new) for new, src in take.items()])
    return Definition(
        inner={f"__{tag}pos": lambda w: F.row_number().over(w), f"__{tag}prev": lambda w: F.lag(payload).over(w)},
        summary={f"__{tag}tail": F.max_by(payload, F.struct(*order_by))},
        carry={f"__{tag}late": lambda w: F.lag(f"__{tag}tail").over(w)},
        result={new: F.when(F.col(f"__{tag}pos") == 1, F.col(f"__{tag}late")[new]).otherwise(F.col(f"__{tag}prev")[new]) for new in take})


def following(order_by: Sequence[str], take: Mapping[str, str], tag: str = "f") -> Definition:
    """The following row's values."""
    payload = F.struct(*[F.col(src).alias(new) for new, src in take.items()])
    return Definition(
        inner={f"__{tag}end": lambda w: F.lead(F.lit(False), 1, True).over(w), f"__{tag}next": lambda w: F.lead(payload).over(w)},
        summary={f"__{tag}head": F.min_by(payload, F.struct(*order_by))},
        carry={f"__{tag}early": lambda w: F.lead(f"__{tag}head").over(w)},
        result={new: F.when(F.col(f"__{tag}end"), F.col(f"__{tag}early")[new]).otherwise(F.col(f"__{tag}next")[new]) for new in take})


def running(sums: Mapping[str, Column], total: Callable = F.sum, zero=0) -> Definition:
    """Inclusive running totals (ROWS frame) of the given expressions."""
    zero = zero if isinstance(zero, Column) else F.lit(zero)
    terms = {n: F.coalesce(e, zero) for n, e in sums.items()}
    add = (lambda a, b: a.bitwiseXOR(b)) if total is F.bit_xor else (lambda a, b: a + b)
    return Definition(
        inner={f"__in_{n}": (lambda w, e=e: total(e).over(upto(w))) for n, e in terms.items()},
        summary={f"__tot_{n}": total(e) for n, e in terms.items()},
        carry={f"__off_{n}": (lambda w, n=n: total(F.col(f"__tot_{n}")).over(before(w))) for n in terms},
        result={n: add(F.col(f"__in_{n}"), F.coalesce(F.col(f"__off_{n}"), zero)) for n in terms})


def gaps(name: str, ts: str, gap_seconds: int) -> Definition:
    """Number of the session: one more at the first row of the key and after every gap of at least ``gap_seconds``."""
    gap = gap_seconds * 1_000_000

    def far(a, b):
        return flag(epoch_micros(b) - epoch_micros(a) >= gap)

    return Definition(
        inner={f"__st_{name}": lambda w: far(F.lag(ts).over(w), ts), f"__no_{name}": lambda w: F.sum(f"__st_{name}").over(upto(w))},
        summary={f"__fi_{name}": F.min(ts), f"__la_{name}": F.max(ts), f"__n_{name}": F.sum(f"__st_{name}")},
        carry={
            # does the chunk's first event open a session?
            f"__be_{name}": lambda w: F.lag(f"__la_{name}").over(w),
            f"__op_{name}": lambda w: F.when(F.col(f"__be_{name}").isNull(), 1).otherwise(far(f"__be_{name}", f"__fi_{name}")),
            f"__of_{name}": lambda w: F.sum(f"__op_{name}").over(upto(w)) + F.coalesce(F.sum(f"__n_{name}").over(before(w)), F.lit(0)),
        },
        result={name: F.col(f"__no_{name}") + F.col(f"__of_{name}")})


def with_previous(df, keys, order_by: Sequence[str], take: Mapping[str, str], chunk: Column) -> DataFrame:
    """Add the previous row's values: ``take`` maps new name -> source column."""
    return scan_all(df, keys, [F.col(c) for c in order_by], chunk, [previous(order_by, take)])


def with_next(df, keys, order_by: Sequence[str], take: Mapping[str, str], chunk: Column) -> DataFrame:
    """Add the following row's values."""
    return scan_all(df, keys, [F.col(c) for c in order_by], chunk, [following(order_by, take)])


def with_running_sum(df, keys, order_by: Sequence[str], sums: Mapping[str, Column], chunk: Column) -> DataFrame:
    """Inclusive running totals (ROWS frame) of the given expressions."""
    return scan_all(df, keys, [F.col(c) for c in order_by], chunk, [running(sums)])


def with_ordinal(df, keys, order_by: Sequence[str], name: str, chunk: Column) -> DataFrame:
    """Position of the row within its key, from 1 (row_number)."""
    return with_running_sum(df, keys, order_by, {name: F.lit(1)}, chunk)


def last_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    take: Mapping[str, str],
    chunk_seconds: int,
    allow_equal: bool = False,
    right_tie: Sequence[str] = (),
    independent: bool = False,
) -> DataFrame:
    """As-of look-up: for each left row the latest right row before it.

    Both sides are laid on one time axis and the last right row is carried
    forward, so no (left, right) pairs are formed. ``take`` maps new name ->
    right column; ``right_tie`` breaks ties among equal right times. With
    ``independent`` every taken column carries its own last non-NULL value.
    """
    return _as_of(left, right, keys, left_ts, right_ts, take, chunk_seconds, allow_equal, right_tie, False, independent)


def first_after(left, right, keys, left_ts, right_ts, take, chunk_seconds, allow_equal=False, right_tie=()) -> DataFrame:
    """As-of look-up: for each left row the earliest right row after it."""
    return _as_of(left, right, keys, left_ts, right_ts, take, chunk_seconds, allow_equal, right_tie, True, False)


def _as_of(left, right, keys, left_ts, right_ts, take, chunk_seconds, allow_equal, right_tie, forward, independent):
    tie = F.struct(*[F.col(c) for c in right_tie]) if right_tie else F.struct(F.lit(0).alias("t"))
    if independent:
        carried = {f"__r_{n}": F.col(src) for n, src in take.items()}
    else:
        carried = {"__r": F.struct(*[F.col(src).alias(n) for n, src in take.items()])}
    lrow = F.struct(*[F.col(c) for c in left.columns])
    r = right.select(*keys, F.col(right_ts).alias("__t"), tie.alias("__tie"),
                     *[c.alias(n) for n, c in carried.items()], F.lit(True).alias("__is_right"))
    lhs = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(False).alias("__is_right"), lrow.alias("__l"))
    axis = lhs.unionByName(r, allowMissingColumns=True)
    # at equal times the side that must be seen later comes later
    late = F.col("__is_right") if not allow_equal else ~F.col("__is_right")
    side = F.when(late, 1).otherwise(0)
    when = F.struct("__t", "__tie")
    if forward:
        order, chunk, pick = [F.col("__t").desc(), side, F.col("__tie").desc()], -time_chunk("__t", chunk_seconds), F.min_by
    else:
        order, chunk, pick = [F.col("__t"), side, F.col("__tie")], time_chunk("__t", chunk_seconds), F.max_by
    out = chunked_scan(
        axis, keys, order, chunk,
        inner={f"__seen{n}": (lambda w, n=n: F.last(n, ignorenulls=True).over(upto(w))) for n in carried},
        summary={f"__best{n}": pick(n, F.when(F.col("__is_right") & F.col(n).isNotNull(), when)) for n in carried},
        carry={f"__past{n}": (lambda w, n=n: F.last(f"__best{n}", ignorenulls=True).over(before(w))) for n in carried},
        result={f"__hit{n}": F.coalesce(F.col(f"__seen{n}"), F.col(f"__past{n}")) for n in carried},
    ).filter(~F.col("__is_right"))
    hit = {n: F.col(f"__hit__r_{n}") if independent else F.col("__hit__r")[n] for n in take}
    return out.select(*[F.col("__l")[c].alias(c) for c in left.columns], *[c.alias(n) for n, c in hit.items()])
