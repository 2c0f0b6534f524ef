"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base rules give spans that always stay. High-recall generators then propose further, overlapping candidates: numbers in
groups, written-out addresses, colon-separated addresses. Boosted trees score each candidate by its format and by the
words before it; candidates from a calibrated threshold up are added unless they overlap a base span. The trees are
trained in numpy on the driver, from examples that a seeded generator writes (there are no labelled spans), and become
one SQL expression; texts never leave the JVM. All work is local to a row: no shuffle, and no state across rows.

Positions come from splitting a text at its matches: starts are running sums of the lengths of pieces and matches, in
blocks, so that thousands of matches in a text stay cheap. Patterns are possessive where this doesn't change what they
match, so that no text makes them backtrack or recurse without bound.

Edge cases: a null text counts as empty: no spans, counts of 0, the digest of the empty string. Texts are taken whole,
positions are in code points. Spans of different kinds may overlap; redaction replaces each stretch of overlapping
spans once, by the first one's kind. Other columns pass through, whatever their names, unless they bear an output's.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nested

KINDS = ["email", "ip", "card", "phone"]
LOCAL = r"[A-Za-z0-9._%+-]"
#: Leftmost matches of these are those of the plain patterns; a run is only entered at its start or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PART = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])|0++)"  # zeros alone leave nothing for the number
VALID_IP = rf"^{PART}(?:\.{PART}){{3}}$"
DOT = r" ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]++"
GENERATORS = {
    # A number doesn't end at the hour of a time of day, so that a date isn't taken with it.
    "number": r"(?<![0-9A-Za-z+@._/:-])(?:\([0-9]{1,4}\)[ ]?|[0-9][ .-](?=[0-9]{3}))?[0-9]{2,}+(?: ?\([0-9]{1,4}\) ?[0-9]++)?(?:[ ./-][0-9]{2,}+)*+(?![0-9A-Za-z@]|:[0-9])",
    # A bare "at" needs a written "dot": a full stop after it ends a sentence.
    "spelled": rf"(?<!{LOCAL}){LOCAL}++(?: ?(?:\[at\]|\(at\)|\{{at\}}) ?[A-Za-z0-9-]++(?:{DOT}|\.[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?:{DOT})++)",
    "colons": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+::?){1,7}[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "number": "", "spelled": "at", "colons": ":"}
CONTEXT = 40
WORDS = {
    "call": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|text|dial|whatsapp|contact|t[ée]l[ée]phone|telefon|tel[ée]fono|handy)\b",
    "pay": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|cc|karte|carte|tarjeta)\b",
    "mail": r"(?i)\b(?:e-?mail|mail|write|contact|reach|address|correo|courriel)\b",
    "host": r"(?i)\b(?:ip|ipv6|host|server|addr|address|inet6?)\b",
    "other": r"(?i)\b(?:isbn|issn|version|page|pages|pp|vol|order|invoice|no|date|year|figure|section|doi|price|total)\b",
}
FEATURES = ["generator", "digits", "groups", "longest", "parens", "dots", "dashes", "spaces", "length", "luhn", "year", "slashes", "colons", "gaps", "letters", "zero", "years", "round", "equal", *WORDS]
BLOCK = 128


def let(value: Column, body) -> Column:
    """body(value), with value computed once: an array of one element binds it."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def matches(text: Column, pattern: str, needs: str = "") -> Column:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches, in code points."""

    def placed(x):
        n = F.size(x["m"])
        steps = F.zip_with(F.slice(x["p"], 1, n), x["m"], lambda p, m: (p + F.length(m)).cast("long"))

        def starts(s):
            sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice(s, b * BLOCK + 1, F.lit(BLOCK))))

            def at(m, i):
                b = F.floor(i / BLOCK).cast("int")
                return b, i

            def within(prefix):
                def one(m, i):
                    b, _ = at(m, i)
                    start = prefix[b] + total(F.slice(s, b * BLOCK + 1, i - b * BLOCK)) + x["p"][i]
                    return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"))

                return F.transform(x["m"], one)

            return let(sums, lambda t: let(F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b))), within))

        return let(steps, starts)

    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, m: string>>)")
    found = let(
        F.struct(F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long")).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")),
        lambda x: F.when(F.size(x["m"]) == 0, none).otherwise(placed(x)),
    )
    likely = text.rlike("[0-9]") if not needs or needs in "+." else text.contains(needs)
    if needs in ("+", "."):
        likely = text.contains(needs) & likely
    return F.when(likely, found).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind_no, end, m>>, unsorted."""

    def valid(kind):
        if kind == "ip":
            return lambda s: s["m"].rlike(VALID_IP)
        if kind == "card":
            return lambda s: let(digits_only(s["m"]), lambda d: F.length(d).between(12, 19) & luhn(d))
        if kind == "phone":
            return lambda s: F.length(digits_only(s["m"])).between(9, 15)
        return lambda s: F.lit(True)

    parts = [F.transform(F.filter(matches(text, PATTERNS[kind], NEEDS[kind]), valid(kind)), as_span(F.lit(no))) for no, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def as_span(kind_no: Column):
    return lambda s: F.struct(s["start"].alias("start"), kind_no.alias("kind_no"), s["end"].alias("end"))


def is_kind(no: int):
    return lambda s: s["kind_no"] == no


def as_number(s: Column) -> Column:
    """A number is a card's from 13 digits up, else a phone's."""
    return as_span(F.when(F.length(digits_only(s["m"])) >= 13, F.lit(2)).otherwise(F.lit(3)))(s)


def feature_columns(generator: int, m: Column, before: Column) -> dict[str, Column]:
    digits = digits_only(m)
    groups = F.filter(F.split(m, "[^0-9A-Za-z]+", -1), lambda g: g != "")
    count = lambda c: F.length(m) - F.length(F.replace(m, F.lit(c), F.lit("")))
    found = {
        "generator": F.lit(generator),
        "digits": F.length(digits),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "parens": count("(") + count("["),
        "dots": count("."),
        "dashes": count("-"),
        "spaces": count(" "),
        "length": F.length(m),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False)).cast("int"),
        "year": m.rlike(r"^(?:19|20)[0-9]{2}(?:[^0-9]|$)").cast("int"),
        "slashes": count("/"),
        "colons": count(":"),
        "gaps": m.contains("::").cast("int"),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "zero": m.rlike("^[0(]").cast("int"),
        "years": F.size(F.filter(groups, lambda g: g.rlike("^(?:19|20)[0-9]{2}$"))),
        "round": F.size(F.filter(groups, lambda g: g.endswith("00"))),
        "equal": F.size(F.array_distinct(F.transform(groups, F.length))),
    }
    return found | {w: before.rlike(p).cast("int") for w, p in WORDS.items()}


def _row(generator: int, m: str, before: str) -> list[float]:
    """The same features in Python, for training."""
    import re

    digits = re.sub("[^0-9]", "", m)
    groups = [g for g in re.split("[^0-9A-Za-z]+", m) if g]
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return [
        generator, len(digits), len(groups), max(map(len, groups), default=0), m.count("(") + m.count("["), m.count("."), m.count("-"), m.count(" "), len(m),
        float(12 <= len(digits) <= 19 and sum(doubled) % 10 == 0), float(bool(re.match(r"(?:19|20)[0-9]{2}(?:[^0-9]|$)", m))),
        m.count("/"), m.count(":"), float("::" in m), len(re.sub("[^A-Za-z]", "", m)),
        float(m[0] in "0("), sum(bool(re.fullmatch("(?:19|20)[0-9]{2}", g)) for g in groups), sum(g.endswith("00") for g in groups), len(set(map(len, groups))),
        *(float(bool(re.search(p, before))) for p in WORDS.values()),
    ]


def examples(n: int = 5000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Written candidates with labels."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    hexes = lambda k: [f"{x:x}" for x in rng.integers(0, 65536, k)]
    pick = lambda *xs: xs[rng.integers(len(xs))]
    filler = lambda: pick("the result of the", "and then we saw", "it is about", "in the table", "there were", "", "see also the list")
    rows, labels = [], []
    for _ in range(n):
        case = rng.integers(0, 22)
        sep = pick(" ", "-", ".")
        if case == 0:
            g, m, b, y = 0, pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0{num(2)}{sep}{num(4)}{sep}{num(4)}"), pick("call me at", "phone:", "tel", "my mobile is", filler()), 1
        elif case == 1:
            g, m, b, y = 0, num(rng.integers(9, 12)), pick("phone", "call", "telefon", "mobile:"), 1
        elif case == 2:
            g, m, b, y = 0, pick(sep.join(num(4) for _ in range(4)), num(16)), pick("visa card", "credit card number", "my card:"), 1
        elif case == 3:
            g, m, b, y = 1, f"{pick('jane.doe', 'sam', 'info', 'k.lee7')}{pick(' [at] ', '(at)', '{at}')}{pick('mail', 'example', 'uni-x')}{pick(' [dot] ', '(dot)', ' dot ', '.')}{pick('com', 'org', 'net', 'de')}", pick("write to", "e-mail", "contact", filler()), 1
        elif case == 4:
            g, m, b, y = 2, ":".join(f"{x:x}" for x in rng.integers(0, 65536, rng.integers(6, 9))), pick("host", "server", "ipv6 address", filler()), 1
        elif case == 5:
            g, m, b, y = 0, pick(f"{rng.integers(1900, 2030)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{rng.integers(1900, 2030)}", f"{rng.integers(1900, 2030)}-{rng.integers(1900, 2030)}"), pick("date", "since", "year", filler()), 0
        elif case == 6:
            g, m, b, y = 0, pick(f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(3)}", f"{num(2)}-{num(2)}", num(rng.integers(2, 9))), pick("total", "price", "order no", "invoice", filler()), 0
        elif case == 7:
            g, m, b, y = 0, pick(f"978-{num(1)}{num(1)}-{num(4)}-{num(4)}-{num(2)}", num(13), f"{num(4)}-{num(4)}"), pick("isbn", "issn", "doi"), 0
        elif case == 8:
            g, m, b, y = 0, pick(num(rng.integers(12, 24)), sep.join(num(rng.integers(2, 6)) for _ in range(rng.integers(5, 12)))), filler(), 0
        elif case == 9:
            named = rng.random() < 0.5  # a bare "at" is an address's where an address is announced
            g, m, b, y = 1, f"{pick('jane', 'sam', 'looked', 'arrived', 'k.lee7')} at {pick('home', 'noon', 'mail', 'example')} dot {pick('com', 'org', 'net')}", pick("write to", "e-mail:", "my address is", "reach me:") if named else filler(), float(named)
        elif case == 10:
            g, m, b, y = 2, ":".join(num(2) for _ in range(rng.integers(4, 6))), pick("time", "at", "ratio", filler()), 0
        elif case == 11:
            g, m, b, y = 0, pick(f"00{num(2)} (0){num(2)} {num(4)} {num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(3)}", f"0{num(2)}/{num(7)}", f"0{num(4)}/{num(6)}", f"1{sep}{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"), pick("call", "telefon", "phone:", "dial", "whatsapp", "fax", filler()), 1
        elif case == 12:
            g, m, b, y = 2, "::".join(":".join(hexes(rng.integers(1, 4))) for _ in range(2)), pick("host", "server", "ping", filler()), 1
        elif case == 13:
            g, m, b, y = 2, pick(":".join(f"{x:02x}" for x in rng.integers(0, 256, 6)), f"{num(2)}:{num(2)}:{num(2)}", "::".join(pick("std", "a", "be", "cafe", "add") for _ in range(2))), pick("mac", "device", "card", "at", "use", filler()), 0
        elif case == 14:
            g, m, b, y = 0, pick(f"{num(2)}/{num(2)}/{rng.integers(1900, 2030)}", f"{rng.integers(1900, 2030)}/{num(2)}", f"{num(3)}/{num(3)}", f"{num(2)}/{num(2)}/{num(2)}"), pick("date", "page", "no", filler()), 0
        elif case == 15:
            g, m, b, y = 0, pick(f"{num(1)} {num(3)} {num(3)}", f"{rng.integers(1, 10)} {num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(3)}.{num(3)}"), pick("total", "population", "a total of", "price", filler()), 0
        elif case == 16:
            g, m, b, y = 0, pick(f"{num(3)}.{num(2)}.{num(2)}", f"{num(2)}.{num(2)}"), pick("version", "section", "figure"), 0
        elif case == 17:
            year = lambda: str(rng.integers(1850, 2050))
            g, m, b, y = 0, pick(" ".join(year() for _ in range(rng.integers(2, 7))), " ".join(f"{year()}-{year()}" for _ in range(rng.integers(1, 4))), f"{year()}-{num(2)}-{num(2)} {num(2)}", f"{year()}-{num(2)}-{num(2)} {num(4)}"), pick("the years", "season", "in", "logged at", filler()), 0
        elif case == 18:
            g, m, b, y = 0, " ".join(num(2) for _ in range(rng.integers(4, 9))), pick("scores", "ages", "the numbers", "a list of", filler()), 0
        elif case == 19:
            g, m, b, y = 0, pick(" ".join(f"{rng.integers(1, 10)}{pick('00', '000', '50', '500')}" for _ in range(rng.integers(2, 6))), " ".join(str(rng.integers(1, 10) * 1000) for _ in range(rng.integers(2, 5))), " ".join(num(4) for _ in range(rng.integers(2, 6)))), pick("rows", "values", "steps", "of", filler()), 0
        elif case == 20:
            g, m, b, y = 0, sep.join(f"{num(rng.integers(1, 4))}.{num(rng.integers(2, 7))}" for _ in range(rng.integers(2, 4))), pick("coords", "coordinates", "at", "position", "measured", filler()), 0
        else:
            g, m, b, y = 0, pick(f"{num(8)} {num(6)}", f"{num(8)}-{num(6)}", " ".join(f"{num(rng.integers(2, 4))}-{num(rng.integers(2, 4))}" for _ in range(rng.integers(2, 4))), " ".join(num(rng.integers(2, 6)) for _ in range(rng.integers(3, 7)))), pick("log", "lines", "range", "pages", filler()), 0
        rows.append(_row(g, m, f"{b} "))
        labels.append(float(y))
    return np.array(rows), np.array(labels)


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int):
    """A regression tree by second-order gains: (feature, bound, below, above) or a leaf's value."""
    leaf = float(-slope.sum() / (curve.sum() + 1.0))
    if not depth or len(slope) < 20:
        return leaf
    best = (1e-3, None)
    whole = slope.sum() ** 2 / (curve.sum() + 1)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in values[:-1][:: max(1, len(values) // 32)]:
            low = x[:, f] <= bound
            a, b = slope[low].sum(), curve[low].sum()
            gain = a * a / (b + 1) + (slope.sum() - a) ** 2 / (curve.sum() - b + 1) - whole
            if gain > best[0]:
                best = (gain, (f, float(bound), low))
    if best[1] is None:
        return leaf
    f, bound, low = best[1]
    return f, bound, _grow(x[low], slope[low], curve[low], depth - 1), _grow(x[~low], slope[~low], curve[~low], depth - 1)


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache
def model(rounds: int = 24, depth: int = 3, rate: float = 0.4, precision: float = 0.995) -> tuple[tuple, float]:
    """(trees, threshold on their sum): the lowest that has this precision on examples not trained on."""
    x, y = examples()
    cut = len(y) * 2 // 3
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score[:cut]))
        tree = _grow(x[:cut], p - y[:cut], p * (1 - p), depth)
        trees.append(tree)
        score += rate * np.array([_value(tree, r) for r in x])
    held, truth = score[cut:], y[cut:]
    bounds = np.sort(held[truth > 0])
    threshold = next((b for b in bounds if truth[held >= b].mean() >= precision), bounds[-1])
    scaled = tuple(_scale(t, rate) for t in trees)
    return scaled, float(max(0.0, threshold))


def _scale(tree, by):
    return tree * by if not isinstance(tree, tuple) else (tree[0], tree[1], _scale(tree[2], by), _scale(tree[3], by))


def _expression(tree, x: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(x[FEATURES[tree[0]]] <= tree[1], _expression(tree[2], x)).otherwise(_expression(tree[3], x))


def score_expression(x: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for tree in model()[0]:
        out = out + _expression(tree, x)
    return out


def added_spans(text: Column, base: Column) -> Column:
    """Candidates that the trees accept and that overlap no base span: array<struct<start, kind_no, end>>."""

    def accepted(generator: int):
        def good(s):
            before = F.substring(text, F.greatest(F.lit(1), s["start"].cast("int") + 1 - CONTEXT), F.least(F.lit(CONTEXT), s["start"].cast("int")))
            features = F.struct(*[c.cast("double").alias(n) for n, c in feature_columns(generator, s["m"], before).items()])
            return let(features, lambda x: score_expression({n: x[n] for n in FEATURES}) >= model()[1])

        return good

    parts = []
    for g, (name, pattern) in enumerate(GENERATORS.items()):
        found = F.filter(matches(text, pattern, NEEDS[name]), lambda s: F.length(s["m"]) >= 7)
        free = F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        span = {"number": as_number, "spelled": as_span(F.lit(0)), "colons": as_span(F.lit(1))}[name]
        parts.append(F.transform(F.filter(free, accepted(g)), span))
    return F.concat(*parts)


def rendered(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_spans(text: Column) -> Column:
    """struct<base, spans> of a text: arrays of struct<start, kind_no, end> by start, then kind (its place in KINDS)."""
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), F.array_sort(F.array_union(b, added_spans(t, b))).alias("spans"))),
    )


def detect(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with base and spans; columns of these names are replaced."""
    held = nested(df.drop("base", "spans"), found=found_spans(F.col(f"`{text_col}`")))
    return held.select("row_.*", "found.base", "found.spans")


def redacted(text: Column, spans: Column) -> Column:
    """text with each stretch of overlapping spans replaced by its first one's kind, as [EMAIL]."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        upto = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], upto, names[s["kind_no"]]).alias("out"), s["end"].alias("at"))
        )

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the spans in text_col replaced; null texts stay null."""
    text = F.col(f"row_.`{text_col}`")
    held = nested(df, found=found_spans(F.col(f"`{text_col}`")))
    clean = F.when(text.isNotNull(), redacted(text, F.col("found.spans"))).alias(text_col)
    return held.select(*[clean if c == text_col else F.col(f"row_.`{c}`") for c in df.columns])
