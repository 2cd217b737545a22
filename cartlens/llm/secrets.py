"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Base spans (kinds assign, access, hex) are the leftmost non-overlapping matches of each pattern, those that are too short dropped; a span is the whole match.
The field tags tokens (runs of letters and digits, single other characters) as secret begin, inside or outside. Features: shape of the token and of its neighbours,
the words up to three tokens before and one after, what it is glued to, and traits of the text (its length and share of digits). Tags are decoded by Viterbi. Tagged runs that
touch no base span are added as kind ``crf``.

Training: the base spans of a bounded sample of texts (``max_rows``, by a hash of the id and text) are the labels, and so are copies of them that the patterns do not find: values that are too short, of
another make (letters of both cases, a brand before them), after other names or none, and ordinary words after such names, which are no secrets. So the field learns what the patterns leave out.
Log-likelihood, stochastic gradient with adaptive steps. ``max_windows`` windows, by a hash, are all that reaches the driver. Decoding is exact: a token whose outside score leads by more than any two transitions can make up
is outside in the best path, so paths are searched between such tokens only.

Null and empty texts have no spans. Repeated rows and ids each get a row. Clashing columns are replaced. Without a base span in the sample no field is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_pieces, mix, replace_column, runs, span_hashes, table, utf8
from .quality import BYTE_CLASS

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more are the matches of [0-9a-f]+ that stay
WORDS = ("passw", "secret", "token", "apikey", "api_key")

OUT, BEGIN, INSIDE = 0, 1, 2
BITS = 16
TEMPLATES = 11
SALTS = np.arange(1, TEMPLATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


@dataclass
class Tokens:
    starts: np.ndarray  # in bytes
    ends: np.ndarray
    row: np.ndarray
    features: np.ndarray  # a bucket for each token and template


def _shift(values: np.ndarray, row: np.ndarray, by: int) -> np.ndarray:
    """Value of the token ``by`` places before (after, if negative) on the same row, 0 where there is none."""
    out = np.zeros_like(values)
    if by > 0:
        ok = row[by:] == row[:-by]
        out[by:][ok] = values[:-by][ok]
    else:
        ok = row[:by] == row[-by:]
        out[:by][ok] = values[-by:][ok]
    return out


def tokenise(data: np.ndarray, bounds: np.ndarray) -> Tokens:
    """Tokens of all rows with their hashed features."""
    kind = BYTE_CLASS[data]
    starts, ends = runs(kind >= 2, bounds)
    single = np.flatnonzero(kind == 1)
    starts, ends = np.concatenate([starts, single]), np.concatenate([ends, single + 1])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    row = np.searchsorted(bounds, starts, "right") - 1
    count = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    within = lambda sums: sums[ends] - sums[starts]
    size = ends - starts
    digits, uppers = count(kind == 3), count(kind == 4)
    n_digit, n_upper = within(digits), within(uppers)
    change = np.zeros(len(data), bool)
    change[1:] = (kind[1:] == 3) != (kind[:-1] == 3)
    n_change = within(count(change))
    n_hex = within(count((kind == 3) | (data >= 97) & (data <= 102)))
    length = np.minimum(size, 15) + (size >= 20) + (size >= 32)
    share = lambda n: (4 * n) // np.maximum(size, 1)
    shape = ((((length * 5 + share(n_digit)) * 5 + share(n_upper)) * 2 + (n_hex == size)) * 4 + np.minimum(n_change, 3) + 1).astype(np.uint64)
    lower = np.where(kind == 4, data + 32, data).astype(np.uint8)
    word = span_hashes(lower, starts, ends)
    glued = np.zeros(len(starts), np.uint64)
    if len(starts) > 1:
        touch = (ends[:-1] == starts[1:]) & (row[1:] == row[:-1])
        glued[1:] += touch
        glued[:-1] += 2 * touch.astype(np.uint64)
    text_size = np.diff(bounds)
    text_digits = digits[bounds[1:]] - digits[bounds[:-1]]
    trait = (np.minimum(np.log2(text_size + 1).astype(np.int64) // 3, 7) * 4 + np.minimum(40 * text_digits // np.maximum(text_size, 1), 3)).astype(np.uint64)
    before, after = _shift(word, row, 1), _shift(word, row, -1)
    two, three = _shift(word, row, 2), _shift(word, row, 3)
    shape_before, shape_after = _shift(shape, row, 1), _shift(shape, row, -1)
    coarse = length.astype(np.uint64) * np.uint64(2) + (n_digit > 0).astype(np.uint64)
    templates = [shape, np.where(size <= 12, word, np.uint64(1)), before, two, three, after, shape_before, shape_after,
                 coarse * np.uint64(4) + glued, trait[row] * np.uint64(64) + coarse, mix(before) ^ coarse]
    made = [(mix(t + salt) >> np.uint64(64 - BITS)).astype(np.int64) for t, salt in zip(templates, SALTS)]
    return Tokens(starts, ends, row, np.stack(made, axis=1) if len(starts) else np.zeros((0, TEMPLATES), np.int64))


@dataclass
class Field:
    weights: np.ndarray  # buckets x tags
    steps: np.ndarray  # from tag x to tag

    def scores(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros((len(features), 3))
        for k in range(features.shape[1]):
            total += self.weights[features[:, k]]
        return total

    def decode(self, scores: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Tags of all tokens by Viterbi, each row a chain."""
        tags = np.zeros(len(scores), np.int8)
        lead = scores[:, OUT] - np.maximum(scores[:, BEGIN], scores[:, INSIDE])
        open_at = np.flatnonzero(lead <= 2 * (self.steps.max() - self.steps.min()))
        if not len(open_at):
            return tags
        cut = np.flatnonzero((np.diff(open_at) > 1) | (np.diff(row[open_at]) != 0)) + 1
        for part in np.split(open_at, cut):
            lo, hi = part[0], part[-1] + 1
            # The neighbours of the part on its row are outside; at the ends of the row there is no step.
            best = scores[lo] + (self.steps[OUT] if lo and row[lo - 1] == row[lo] else 0)
            back = np.zeros((hi - lo, 3), np.int8)
            for i in range(lo + 1, hi):
                ways = best[:, None] + self.steps
                back[i - lo] = ways.argmax(0)
                best = ways.max(0) + scores[i]
            if hi < len(row) and row[hi] == row[lo]:
                best = best + self.steps[:, OUT]
            tag = int(best.argmax())
            for i in range(hi - 1, lo - 1, -1):
                tags[i] = tag
                tag = back[i - lo][tag]
        return tags


def fit(features: np.ndarray, tags: np.ndarray, mask: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.3) -> Field:
    """Log-likelihood by forward and backward sums over windows of equal length; ``mask`` marks true tokens. The order is fixed."""
    field, rng = Field(np.zeros((1 << BITS, 3)), np.zeros((3, 3))), np.random.default_rng(0)
    seen, seen_steps = np.full((1 << BITS, 3), 1e-2), np.full((3, 3), 1e-2)
    n, width = tags.shape
    hot = np.eye(3)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at:at + batch]
            f, y, m = features[pick], tags[pick], mask[pick]
            e = field.weights[f].sum(2) * m[..., None]
            step = lambda i: np.where(m[:, i, None, None], field.steps, 0.0)
            a, b = np.empty_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for i in range(1, width):
                a[:, i] = np.where(m[:, i, None], np.logaddexp.reduce(a[:, i - 1, :, None] + step(i), axis=1) + e[:, i], a[:, i - 1])
            for i in range(width - 2, -1, -1):
                nxt = np.logaddexp.reduce(step(i + 1) + (e[:, i + 1] + b[:, i + 1])[:, None, :], axis=2)
                b[:, i] = np.where(m[:, i + 1, None], nxt, b[:, i + 1])
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            gap = (np.exp(a + b - z[:, None, None]) - hot[y]) * m[..., None]
            grad = np.zeros_like(field.weights)
            for k in range(features.shape[2]):
                for t in range(3):
                    grad[:, t] += np.bincount(f[..., k].ravel(), gap[..., t].ravel(), 1 << BITS)
            grad_steps = np.zeros((3, 3))
            for i in range(1, width):
                p = np.exp(a[:, i - 1, :, None] + field.steps + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None]) - hot[y[:, i - 1]][:, :, None] * hot[y[:, i]][:, None, :]
                grad_steps += (p * m[:, i, None, None]).sum(0)
            grad, grad_steps = grad / len(pick) + 1e-6 * field.weights, grad_steps / len(pick)
            seen += grad ** 2
            seen_steps += grad_steps ** 2
            field.weights -= rate * grad / np.sqrt(seen)
            field.steps -= rate * grad_steps / np.sqrt(seen_steps)
    return field


def _byte_places(text: str, places: list[int]) -> list[int]:
    return [len(text[:p].encode()) for p in places]


#: Training copies: names that may stand before a secret, what stands between, and characters of values.
NAMES = ("pwd", "pass", "passphrase", "db_pwd", "auth", "bearer", "authorization", "credential", "private_key", "access_key", "signing_key", "client_id")
SHORT_NAMES = ("password", "passwd", "secret", "token", "api_key", *NAMES)
LINKS = ("=", " = ", ": ", " ", "='", " = '", '="', ': "')
MIXED = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
AROUND = 200
#: Rounds of copies of each span.
COPIES = 2


def hidden_copies(text: str, start: int, end: int, value: int, rng: np.random.Generator) -> Iterator[tuple[str, int, int]]:
    """(text, start, end of the value) of copies of a base span's surroundings in which no pattern finds it: the value is too short, stands after another name, or is of another make, with or
    without a name. In the last copy an ordinary word of the text stands there, which is no secret (its place is empty)."""
    draw = lambda n, low=len(MIXED): "".join(MIXED[i] for i in rng.integers(0, low, n))
    letters = lambda n: "".join(MIXED[i] for i in rng.integers(10, 36, n))
    pick = lambda of: of[rng.integers(len(of))]
    named = lambda: pick(NAMES) + pick(LINKS)
    key = text[start:value] if value > start and rng.random() < 0.5 else pick(SHORT_NAMES) + pick(LINKS)
    brand = letters(int(rng.integers(2, 5))) + "_" + (letters(4) + "_" if rng.random() < 0.5 else "")
    before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
    short = draw(int(rng.integers(8, 12)), 36) if rng.random() < 0.5 else text[value:end][:int(rng.integers(8, 12))]
    for name, made in ((key, short), (named(), draw(int(rng.integers(9, 41)))), (named() if rng.random() < 0.5 else "", brand + draw(int(rng.integers(16, 37))))):
        at = len(before) + len(name)
        copy, to = before + name + made + after, at + len(made)
        if any(x.isdigit() for x in made) and not any(s < to and at < e for s, _, e, _ in base_spans(copy)):
            yield copy, at, to
    words = re.findall(r"[^\W\d_]{3,}", before)
    if words:
        yield before + named() + words[rng.integers(len(words))] + after, len(before), len(before)


def _tagged(text: str, places: list[tuple[int, int]]) -> tuple[Tokens, np.ndarray, list[int]]:
    """Tokens of a text, their tags, and the first token of each place that holds some."""
    data = np.frombuffer(text.encode(), np.uint8)
    tokens = tokenise(data, np.array([0, len(data)]))
    tags, first = np.zeros(len(tokens.starts), np.int8), []
    for start, end in zip(_byte_places(text, [p[0] for p in places]), _byte_places(text, [p[1] for p in places])):
        inside = np.flatnonzero((tokens.starts >= start) & (tokens.ends <= end))
        if len(inside) and not tags[inside].any():
            tags[inside] = INSIDE
            tags[inside[0]] = BEGIN
            first.append(int(inside[0]))
    return tokens, tags, first


def windows_of(text: str, key: int, width: int, most: int = 8) -> Iterator[tuple[bytes, bytes]]:
    """(features, tags) of training windows: around ``most`` base spans of the text at most and their hidden copies, and for one text in six somewhere else and around its longest token."""
    spans = base_spans(text)
    if not spans and key % 6:
        return
    tokens, tags, centres = _tagged(text, [(s[3], s[2]) for s in spans])
    n, rng = len(tokens.starts), np.random.default_rng(key)
    if not n:
        return

    def window(t: Tokens, y: np.ndarray, c: int) -> tuple[bytes, bytes]:
        lo = max(0, min(c - width // 2, len(y) - width))
        return t.features[lo:lo + width].astype("<i4").tobytes(), y[lo:lo + width].tobytes()

    if key % 6 == 0:
        for c in (key // 6 % n, int(np.argmax(np.where(tags == OUT, tokens.ends - tokens.starts, 0)))):
            yield window(tokens, tags, c)
    for c in rng.permutation(centres)[:most]:
        yield window(tokens, tags, int(c))
    for i in rng.permutation(len(spans))[:most]:
        start, _, end, value = spans[i]
        for copy, at, to in (c for _ in range(COPIES) for c in hidden_copies(text, start, end, value, rng)):
            around = [(s[3], s[2]) for s in base_spans(copy)]
            t, y, first = _tagged(copy, [(at, to), *around] if to > at else around)
            place = first[0] if to > at and first else int(np.searchsorted(t.starts, len(copy[:at].encode())))
            if len(y):
                yield window(t, y, min(place, len(y) - 1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 24000, width: int = 32, max_windows: int = 48000) -> Field | None:
    """Field from the base spans of at most about ``max_rows`` texts; None if there are none. ``max_windows`` windows at most, the least by a hash, reach the driver, where the field is fitted."""
    total = docs.count()
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    chosen = docs.filter(F.col(f"`{text_col}`").isNotNull()).select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    if total > max_rows:
        chosen = chosen.filter(F.expr("pmod(key, 1048576)") < int(1048576 * max_rows / total))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(k, *w) for k, text in zip(b.key, b.text) for w in windows_of(text, (k >> 20) & 0xFFFFFFFF, width)]
            yield pd.DataFrame(made, columns=["key", "features", "tags"])

    # Windows of repeated rows are equal, and one of each is enough; each task hands on no more than are wanted.
    made = chosen.mapInPandas(cut, "key long, features binary, tags binary").dropDuplicates()
    rows = made.orderBy(F.xxhash64("key", "features", "tags"), "key", "features").limit(max_windows).toPandas()
    if not any(any(t) for t in rows.tags):
        return None
    rows = rows.sort_values(["key", "features"])
    features, tags = np.zeros((len(rows), width, TEMPLATES), np.int32), np.zeros((len(rows), width), np.int8)
    mask = np.zeros((len(rows), width), bool)
    for i, (f, t) in enumerate(zip(rows.features, rows.tags)):
        n = len(t)
        features[i, :n] = np.frombuffer(f, "<i4").reshape(n, TEMPLATES)
        tags[i, :n] = np.frombuffer(t, np.int8)
        mask[i, :n] = True
    return fit(features, tags, mask)


def field_spans(field: Field, data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Tagged runs of each row that has some, as byte spans counted from the row's start."""
    tokens = tokenise(data, bounds)
    tags = field.decode(field.scores(tokens.features), tokens.row)
    found: dict[int, list[tuple[int, int]]] = {}
    open_row = -1
    last = -2
    for i in np.flatnonzero(tags):
        row = int(tokens.row[i])
        lo, hi = int(tokens.starts[i] - bounds[row]), int(tokens.ends[i] - bounds[row])
        if tags[i] == INSIDE and last == i - 1 and open_row == row:
            found[row][-1] = (found[row][-1][0], hi)
        else:
            found.setdefault(row, []).append((lo, hi))
        open_row, last = row, i
    return found


def all_spans(field: Field | None, texts: pa.Array) -> list[list[tuple[int, str, int]]]:
    """(start, kind, end) of every span of each text, in code points, by start and kind."""
    more = field_spans(field, *utf8(texts)) if field else {}
    out = []
    for i, text in enumerate(texts.to_pylist()):
        spans = [(s, k, e) for s, k, e, _ in base_spans(text)] if text else []
        if i in more:
            raw, base = text.encode(), list(spans)
            for lo, hi in more[i]:
                lo, hi = len(raw[:lo].decode(errors="ignore")), len(raw[:hi].decode(errors="ignore"))
                if hi > lo and not any(s < hi and lo < e for s, _, e in base):
                    spans.append((lo, "crf", hi))
            spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
        out.append(spans)
    return out


def scan(docs: DataFrame, field: Field | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and ``found``: (kind, start, end) of every span in code points, end exclusive."""
    keep = replace_column(docs.select(*[f"`{c}`" for c in keep]) if keep is not None else docs, "found")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def find(text: pa.Array) -> pa.Array:
        return in_pieces(text, lambda part: pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in x] for x in all_spans(field, part)], kind))

    return docs.select(*[F.col(f"`{c}`") for c in keep], find(F.col(f"`{text_col}`")).alias("found"))


def masked(docs: DataFrame, field: Field | None, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask`` (overlapping spans by one); rows and columns stay."""

    def covered(text: str | None, spans: list[tuple[int, str, int]]) -> str | None:
        at, parts = 0, []
        for s, _, e in sorted(spans, key=lambda s: (s[0], -s[2])):
            if s >= at:
                parts += [text[at:s], mask]
            at = max(at, e)
        return "".join(parts) + text[at:] if parts else text

    @F.arrow_udf("string")
    def cover(text: pa.Array) -> pa.Array:
        return in_pieces(text, lambda part: pa.array([covered(t, s) for t, s in zip(part.to_pylist(), all_spans(field, part))], pa.string()))

    text = F.col(f"`{text_col}`")
    return docs.select(*[cover(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs), keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.format_string("%s:%d:%d", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    base = F.filter("found", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size(of("crf")).cast("long").alias("n_crf"))
