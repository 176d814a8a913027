"""Personal data by candidate gradient boosting, with DataFrame functions alone.

High-recall generators propose spans that may overlap: the fixed patterns (their checked matches are base spans,
which always stay), and wider ones: numbers in telephone form, addresses with a disguised "at" or "dot", IP
addresses with disguised dots, and card numbers with other or longer separators. Boosted trees score the wider
candidates by format (digits, separators, brackets, length, checksum) and context (neighbouring characters, cue
words); a disguised sign counts as the plain one. Spark counts the candidates of a sample of documents by
combination of features and by whether a checked span of their kind meets them, save those in disguise, which no
check can confirm: they are scored like plain ones of their shape. The trees are fitted on that table, calibrated on
a fifth of the documents, and become SQL expressions. Candidates at or above the threshold join the spans unless
they overlap a base span.

The fit alone is bounded: ``SAMPLE`` documents in expectation, chosen by hash of the row, and ``COMBOS`` combinations
of feature values, the first by hash. Spans are found in every whole text; offsets and overlaps are worked out by
running sums over blocks, so that n matches take n * sqrt(n) steps at most.

Null and empty texts have no spans. Equal texts get equal spans. Without a positive candidate nothing is added. An
empty table gives an empty one. Other columns stay, but for one that has the result's name, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tessera.llm.spans import SPANS

KINDS = ["email", "ip", "card", "phone"]
#: The fixed patterns, written so that no text makes them backtrack far: greedy runs that nothing can follow are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider generators, by the kind that they propose.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]++(?:(?:\.|\x20?[\[(](?:\.|dot)[\])]\x20?)[0-9]++){3,}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,3}[0-9]){11,}+",
    "phone": r"(?<![0-9])\+?\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,}+",
}
#: Disguised signs of a kind, with the spaces about them, and what they stand for.
DISGUISES = {
    "email": {r"\x20?[(\[]at[)\]]\x20?": "@", r"\x20?[(\[]dot[)\]]\x20?": "."},
    "ip": {r"\x20?[\[(](?:\.|dot)[\])]\x20?": "."},
    "card": {r"[\x20./_-]{2,3}|[./_]": "-"},
    "phone": {},
}
#: What a text must hold for a kind's patterns to match anything that counts.
NEEDS = {
    "email": r"@|[\[(]at[\])]",
    "ip": r"[0-9](?:\.|\x20?[\[(](?:\.|dot)[\])]\x20?)[0-9]",
    "card": r"[0-9](?:[\x20./_-]{0,3}[0-9]){11}",
    "phone": r"[0-9](?:[\x20().-]*[0-9]){6}",
}
CONTEXT = 12

#: Documents of the fit in expectation, and combinations of feature values that it takes at most.
SAMPLE, COMBOS = 20_000, 4096
ROUNDS, DEPTH, RATE = 16, 3, 0.4
#: Calibrated probability from which a candidate is redacted.
REDACT_AT = 0.9
FEATURES = ["kind", "digits", "length", "dashes", "dots", "spaces", "brackets", "checksum", "before", "after", "cue"]

_ITEM = "array<struct<start: int, end: int, match: string, before: string, after: string>>"
_FAR = 2_147_483_647


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def in_blocks(items: Column) -> Column:
    """A non-empty array as an array of slices, about as many as each has items."""
    n = F.size(items)
    width = F.ceil(F.sqrt(n)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda i: F.slice(items, i * width + 1, width))


def running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """Array of ints whose item i is op over the values before i, from zero on; only blocks grow item by item."""
    none = F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def scan(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def run(blocks: Column) -> Column:
        wholes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), lambda x, y: op(x, y).cast("int")))
        return let(scan(wholes, F.lit(zero)), lambda starts: F.flatten(F.zip_with(blocks, starts, scan)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(in_blocks(v), run)).otherwise(none))


def located(text: Column, pattern: str) -> Column:
    """Array of a pattern's matches with their places in code points and their neighbours: what stands between them gives the offsets."""

    def placed(v: Column) -> Column:
        found, gaps = v["found"], v["gaps"]
        lengths = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def item(at: Column) -> Callable[[Column, Column], Column]:
            def of(m: Column, i: Column) -> Column:
                before, start = F.get(gaps, i), F.get(at, i) + F.length(F.get(gaps, i))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), F.substring(before, -CONTEXT, CONTEXT).alias("before"), F.substring(F.get(gaps, i + 1), 1, CONTEXT).alias("after"))

            return of

        return let(running(lengths, 0, lambda x, y: x + y), lambda at: F.transform(found, item(at)))

    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return let(F.struct(found.alias("found"), gaps.alias("gaps")), placed).cast(_ITEM)


def matches(text: Column, kind: str, pattern: str) -> Column:
    """located, for texts that hold what the kind needs."""
    return F.when(text.rlike(NEEDS[kind]), located(text, pattern)).otherwise(F.array().cast(_ITEM))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def octets(match: Column) -> Column:
    """Whether all dotted parts are at most 255."""

    def small(part: Column) -> Column:
        value = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(value) <= 3, value.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(match, r"\.", -1), small)


def valid(kind: str, match: Column) -> Column:
    """The fixed check of a kind's match."""
    number = digits(match)
    if kind == "ip":
        return octets(match)
    if kind == "card":
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(9, 15)
    return F.lit(True)


def base_of(text: Column, kind: str) -> Column:
    """The checked matches of a kind's fixed pattern."""
    kept = F.filter(matches(text, kind, PATTERNS[kind]), lambda x: valid(kind, x["match"]))
    return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def base(text: Column) -> Column:
    """The checked matches of all fixed patterns."""
    return F.concat(*[base_of(text, kind) for kind in KINDS])


def _side(text: Column, pattern: str) -> Column:
    """Class of the neighbouring character that a pattern picks: 0 none, 1 letter, 2 space, 3 digit, 4 other."""
    c = F.regexp_extract(text, pattern, 0)
    return F.when(c == "", 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike(r"\s"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)


def _few(count: Column, most: int) -> Column:
    return F.least(count, F.lit(most)).cast("int")


def described(kind: str, x: Column) -> Column:
    """A candidate with its features, all small whole numbers, and whether it is in disguise what its kind's pattern takes."""
    m, number = x["plain"], x["number"]

    def times(pattern: str, most: int) -> Column:
        return _few(F.length(m) - F.length(F.regexp_replace(m, pattern, "")), most)

    if kind == "ip":
        checksum = F.when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$") & octets(m), 2).otherwise(1)
    else:
        checksum = F.when(F.length(number).between(12, 19), F.when(luhn(number), 2).otherwise(1)).otherwise(0)
    values = {
        "kind": F.lit(list(WIDE).index(kind)),
        "digits": _few(F.length(number), 20),
        "length": _few(F.floor(F.length(m) / 4), 12),
        "dashes": times("-", 4),
        "dots": times(r"\.", 4),
        "spaces": times(" ", 4),
        "brackets": times(r"[()]", 2),
        "checksum": checksum,
        "before": _side(x["before"], r"(?s).$"),
        "after": _side(x["after"], r"(?s)^."),
        "cue": F.when(x["before"].rlike(r"(?i)(tel|phone|call|fax|mobile|mail|contact)[^a-z0-9]*$"), 1).otherwise(0),
    }
    disguised = (m != x["match"]) & m.rlike(PATTERNS[kind]) & valid(kind, m)
    return F.struct(F.lit(kind).alias("name"), x["start"].alias("start"), x["end"].alias("end"), disguised.alias("disguised"), *[values[f].cast("int").alias(f) for f in FEATURES])


def undisguised(kind: str, match: Column) -> Column:
    """A match with its disguised signs as plain ones."""
    for pattern, sign in DISGUISES[kind].items():
        match = F.regexp_replace(match, pattern, sign)
    return match


def proposed(text: Column, kind: str) -> Column:
    """A kind's wider candidates, with their features, in order of place."""

    def of(x: Column) -> Column:
        fields = [x[c].alias(c) for c in ("start", "end", "match", "before", "after")]
        return let(F.struct(*fields, undisguised(kind, x["match"]).alias("plain"), digits(x["match"]).alias("number")), lambda y: described(kind, y))

    return F.transform(matches(text, kind, WIDE[kind]), of)


def candidates(text: Column) -> Column:
    """All proposals of the wider generators, with their features."""
    return F.concat(*[proposed(text, kind) for kind in WIDE])


def meets(found: Column, spans: Column) -> Column:
    """Array of whether each of the candidates found overlaps any of the spans.

    Both are put in one order of start: a candidate overlaps a span before it that ends past its start, or one after it that
    starts before its end.
    """

    def marks(c: Column) -> Column:
        own = F.transform(c, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i")))
        fixed = F.transform(spans, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(-1).alias("i")))
        return let(F.array_sort(F.concat(fixed, own)), flags)

    def flags(both: Column) -> Column:
        ends = F.transform(both, lambda x: F.when(x["i"] < 0, x["end"]).otherwise(0))
        starts = F.transform(F.reverse(both), lambda x: F.when(x["i"] < 0, x["start"]).otherwise(_FAR))
        scans = F.struct(running(ends, 0, lambda x, y: F.greatest(x, y)).alias("ends"), F.reverse(running(starts, _FAR, lambda x, y: F.least(x, y))).alias("starts"))
        return let(scans, lambda v: F.transform(both, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(v["ends"], k) > x["start"]) | (F.get(v["starts"], k) < x["end"])).alias("meets"))))

    def run(c: Column) -> Column:
        return F.transform(F.array_sort(F.filter(marks(c), lambda x: x["i"] >= 0)), lambda x: x["meets"])

    return let(found, lambda c: F.when(F.size(c) > 0, run(c)).otherwise(F.array().cast("array<boolean>")))


# ---------------------------------------------------------------- boosted trees over the table of combinations


def grow(rows: list[tuple], residual: list[float], hess: list[float], depth: int) -> dict:
    """A regression tree on feature combinations, by greatest gain; leaves hold Newton steps."""

    def leaf(at: list[int]) -> float:
        return sum(residual[i] for i in at) / (sum(hess[i] for i in at) + 1.0)

    def gain(at: list[int]) -> float:
        return sum(residual[i] for i in at) ** 2 / (sum(hess[i] for i in at) + 1.0)

    def build(at: list[int], left: int) -> dict:
        best = (1e-3, None)
        if left:
            whole = gain(at)
            for f in range(len(FEATURES)):
                for cut in sorted({rows[i][f] for i in at})[:-1]:
                    low = [i for i in at if rows[i][f] <= cut]
                    high = [i for i in at if rows[i][f] > cut]
                    better = gain(low) + gain(high) - whole
                    if better > best[0]:
                        best = (better, (f, cut, low, high))
        if best[1] is None:
            return {"leaf": leaf(at)}
        f, cut, low, high = best[1]
        return {"feature": f, "cut": cut, "low": build(low, left - 1), "high": build(high, left - 1)}

    return build(list(range(len(rows))), depth)


def value(tree: dict, row: tuple) -> float:
    while "leaf" not in tree:
        tree = tree["low"] if row[tree["feature"]] <= tree["cut"] else tree["high"]
    return tree["leaf"]


def boost(table: list[tuple[tuple, float, float]]) -> tuple[float, list[dict]]:
    """(prior, trees) for rows of (features, count, positives), by gradient boosting on the logistic loss."""
    rows, n, y = [r[0] for r in table], [r[1] for r in table], [r[2] for r in table]
    total, positive = sum(n), sum(y)
    scale = 1000.0 / total if total > 1000 else 1.0
    prior = log((positive + 0.5) / (total - positive + 0.5))
    score, trees = [prior] * len(rows), []
    for _ in range(ROUNDS):
        p = [1 / (1 + exp(-max(-30.0, min(30.0, s)))) for s in score]
        tree = grow(rows, [scale * (b - a * q) for a, b, q in zip(n, y, p, strict=True)], [scale * a * q * (1 - q) for a, q in zip(n, p, strict=True)], DEPTH)
        trees.append(tree)
        score = [s + RATE * value(tree, r) for s, r in zip(score, rows, strict=True)]
    return prior, trees


def platt(scores: list[float], n: list[float], y: list[float]) -> tuple[float, float]:
    """Slope and shift of the logistic calibration of weighted scores."""
    slope, shift = 1.0, 0.0
    for _ in range(60):
        g0 = g1 = h00 = h01 = h11 = 1e-6
        for s, a, b in zip(scores, n, y, strict=True):
            p = 1 / (1 + exp(-max(-30.0, min(30.0, slope * s + shift))))
            v = a * max(p * (1 - p), 1e-9)
            e = a * p - b
            g0, g1, h00, h01, h11 = g0 + e * s, g1 + e, h00 + v * s * s, h01 + v * s, h11 + v
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        most = max(abs(d0), abs(d1), 1.0)
        slope, shift = slope - d0 / most, shift - d1 / most
    return slope, shift


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """About so many rows of docs, by hash of all their columns but maps."""
    n = docs.count()
    place = F.xxhash64(F.lit(5), *[F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, MapType)]).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    return docs if n <= sample else docs.filter(place * F.lit(n) < sample)


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict | None:
    """Trees and calibration from the candidates of a sample of docs that a check can judge; None if none of them is positive."""
    t = F.col(text)
    fold = (F.pmod(F.xxhash64(t, F.lit(3)), F.lit(5)) == 0).alias("held")

    def marked(kind: str) -> Column:
        def of(v: Column) -> Column:
            return let(meets(v["c"], v["b"]), lambda y: F.transform(v["c"], lambda c, i: F.struct(F.get(y, i).cast("int").alias("y"), c.alias("c"))))

        return let(F.struct(proposed(t, kind).alias("c"), base_of(t, kind).alias("b")), of)

    rows = sampled(docs, sample).filter(t.isNotNull()).select(fold, F.explode(F.concat(*map(marked, WIDE))).alias("c")).select("held", "c.y", "c.c.*").filter("NOT disguised")
    counted = rows.groupBy("held", *FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    first = counted.orderBy(F.xxhash64("held", *FEATURES), "held", *FEATURES).limit(COMBOS)
    table = sorted(((*(r[f] for f in FEATURES),), r.held, float(r.n), float(r.y)) for r in first.collect())
    learn = [(x, n, y) for x, held, n, y in table if not held]
    if not sum(y for _, _, y in learn):
        return None
    prior, trees = boost(learn)
    kept = [(x, n, y) for x, held, n, y in table if held] or learn
    slope, shift = platt([prior + RATE * sum(value(t, x) for t in trees) for x, _, _ in kept], [n for _, n, _ in kept], [y for _, _, y in kept])
    return {"prior": prior, "trees": trees, "slope": max(slope, 0.0), "shift": shift}


def probability(c: Column, model: dict) -> Column:
    """The calibrated probability of a candidate, as nested conditions."""

    def branch(tree: dict) -> Column:
        if "leaf" in tree:
            return F.lit(float(tree["leaf"]))
        return F.when(c[FEATURES[tree["feature"]]] <= tree["cut"], branch(tree["low"])).otherwise(branch(tree["high"]))

    score = F.lit(float(model["prior"]))
    for tree in model["trees"]:
        score = score + F.lit(RATE) * branch(tree)
    return 1 / (1 + F.exp(-(score * F.lit(model["slope"]) + F.lit(model["shift"]))))


def spans_of(text: Column, model: dict | None, redact_at: float = REDACT_AT) -> Column:
    """A text's spans: base ones, and those that the model adds, by start, then kind as listed."""
    order = {kind: i for i, kind in enumerate(KINDS)}

    def sortable(kind: Column, x: Column, fixed: bool, score: Column) -> Column:
        rank = F.element_at(F.create_map(*[F.lit(v) for item in order.items() for v in item]), kind)
        return F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), kind.alias("kind"), F.lit(fixed).alias("base"), score.cast("double").alias("score"))

    def added(c: Column, b: Column) -> Column:
        def of(y: Column) -> Column:
            scored = F.transform(c, lambda x, i: F.when(~F.get(y, i), sortable(x["name"], x, False, probability(x, model))))
            return F.filter(scored, lambda s: F.coalesce(s["score"] >= redact_at, F.lit(False)))

        return let(meets(c, b), of)

    def whole(b: Column) -> Column:
        fixed = F.transform(b, lambda x: sortable(x["kind"], x, True, F.lit(None)))
        every = fixed if model is None else F.concat(fixed, let(candidates(text), lambda c: added(c, b)))
        return F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))

    some = text.rlike("|".join(NEEDS.values()))
    return F.when(some, let(base(text), whole)).otherwise(F.array()).cast(SPANS)


def find(docs: DataFrame, text: str = "text", into: str = "pii", model: dict | None = None, redact_at: float = REDACT_AT, sample: int = SAMPLE) -> DataFrame:
    """docs with a column of spans; without a model, one is fitted on docs."""
    model = fit(docs, text, sample) if model is None else model
    return docs.withColumn(into, spans_of(docs[text], model, redact_at))


def redacted(text: Column, spans: Column) -> Column:
    """text with each stretch that spans cover replaced by its first span's kind, as in <EMAIL>; spans are in order of start."""

    def block(b: Column) -> Column:
        lo = b[0]["at"]
        part = F.struct(lo.alias("lo"), F.substring(text, lo + 1, F.element_at(b, -1)["start"] - lo).alias("text"))
        return let(part, lambda v: F.array_join(F.transform(b, lambda y: F.concat(F.substring(v["text"], y["at"] - v["lo"] + 1, y["start"] - y["at"]), F.lit("<"), F.upper(y["kind"]), F.lit(">"))), ""))

    def cut(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: x["end"]), 0, lambda x, y: F.greatest(x, y))
        placed = let(ends, lambda at: F.transform(s, lambda x, i: F.struct(F.get(at, i).alias("at"), x["start"].alias("start"), x["kind"].alias("kind"))))
        pieces = let(F.filter(placed, lambda y: y["start"] >= y["at"]), lambda f: F.array_join(F.transform(in_blocks(f), block), ""))
        return F.concat(pieces, F.substring(text, F.array_max(F.transform(s, lambda x: x["end"])) + 1, F.length(text)))

    return let(spans, lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(text))
