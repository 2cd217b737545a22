"""Column builders shared by the operators. All are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double, NULL when the denominator is 0 or NULL (ANSI-safe)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 otherwise (also when it is NULL)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def money(c: Column | str) -> Column:
    """Exact two-digit amount: sums do not depend on the order of the rows."""
    return col(c).cast("decimal(18,2)")


def sum_money(c: Column | str) -> Column:
    return F.sum(money(c)).cast("double")


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    out = F.when(*_rule(rules[0]))
    for r in rules[1:]:
        out = out.when(*_rule(r))
    return out.otherwise(_lit(default))


def _lit(v):
    return v if isinstance(v, Column) else F.lit(v)


def _rule(r):
    return r[0], _lit(r[1])


def bands(c: Column | str, edges: Sequence[float], labels: Sequence[str] | None = None,
          right_closed: bool = False) -> Column:
    """Label of the bin between consecutive edges; NULL outside all bins.

    ``right_closed=False`` gives [a, b) bands, ``True`` gives (a, b] bins.
    """
    c = col(c)
    labels = labels or [f"({a}, {b}]" if right_closed else f"[{a}, {b})" for a, b in zip(edges, edges[1:])]
    rules = []
    for a, b, name in zip(edges, edges[1:], labels):
        cond = (c > a) & (c <= b) if right_closed else (c >= a) & (c < b)
        rules.append((cond, name))
    return first_match(rules)


def open_bands(c: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bands without outer limits: len(labels) == len(cuts) + 1."""
    c = col(c)
    rules = [(c < cut, name) for cut, name in zip(cuts, labels)]
    return first_match(rules + [(c.isNotNull(), labels[-1])])


def json_text(doc: Column | str, *paths: str) -> Column:
    """First non-null value among JSON paths, as text."""
    return F.coalesce(*[F.get_json_object(col(doc), p) for p in paths])


def json_bool(doc: Column | str, *paths: str) -> Column:
    return json_text(doc, *paths).try_cast("boolean")


def json_number(doc: Column | str, *paths: str, to: str = "bigint") -> Column:
    return json_text(doc, *paths).try_cast(to)


def code_name(c: Column | str, names: Mapping, default: str | None = None) -> Column:
    """Look a code up in a small fixed mapping (a literal map, no join)."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), col(c))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    """True when the text holds at least one of the words (literal match); never without words."""
    if not words:
        return F.lit(False)
    # A backslash before what is no letter or digit stands for that character.
    return col(c).rlike("|".join("".join(x if x.isalnum() else "\\" + x for x in w) for w in words))


def hashable(kind: T.DataType) -> bool:
    """Whether Spark can hash values of a type (not maps and variants)."""
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind)
    return hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """Hash of a row, of the columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if hashable(f.dataType)])


def same_text(a: Column | str, b: Column | str) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def not_equal_or_null(c: Column | str, value) -> Column:
    """c <> value, keeping NULLs."""
    return ~col(c).eqNullSafe(_lit(value))


def label_null(c: Column | str, label: str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(label))


def fold(c: Column | str, keep: Sequence, other: str = "Others") -> Column:
    return F.when(col(c).isin(list(keep)), col(c)).otherwise(F.lit(other))


def last_token(c: Column | str, sep: str) -> Column:
    return F.element_at(F.split(col(c), "\\Q" + sep + "\\E"), -1)


def slug(name: str) -> str:
    """Column-safe name: lower case, runs of other signs become one underscore."""
    out = "".join(ch.lower() if ch.isalnum() else " " for ch in name)
    return "_".join(out.split()) or "col"


def slug_columns(df: DataFrame) -> DataFrame:
    """Sanitise all headers; repeated names get a running number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        s = slug(c)
        seen[s] = seen.get(s, 0) + 1
        names.append(s if seen[s] == 1 else f"{s}_{seen[s]}")
    return df.toDF(*names)


def plain_number(c: Column | str, to: str = "double") -> Column:
    """Number out of text with thousands commas, currency or percent signs."""
    return F.regexp_replace(col(c).cast("string"), "[^0-9.+-]", "").try_cast(to)


def percent_text(c: Column | str) -> Column:
    """0.1234 -> '12.34%'."""
    return F.concat(F.format_string("%.2f", F.round(col(c) * 100, 2)), F.lit("%"))


def indian_grouping(c: Column | str) -> Column:
    """Whole number with Indian digit groups: 1234567 -> '12,34,567'."""
    return F.regexp_replace(col(c).cast("bigint").cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")


def hex_channel(c: Column | str, index: int) -> Column:
    """Red, green or blue share (0..1) of a '#rrggbb' colour."""
    part = F.substring(F.regexp_replace(col(c), "^#", ""), 1 + 2 * index, 2)
    return F.conv(part, 16, 10).cast("double") / 255


def local_date(epoch_seconds: Column | str, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(col(epoch_seconds)), zone))


def epoch_micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))
