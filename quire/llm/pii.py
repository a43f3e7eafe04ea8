"""Personal data: format generators, boosted trees over format and context, calibrated thresholds.

Everything here is DataFrame expressions. Base matches come from fixed formats. High-recall generators propose
further, overlapping spans. A gradient-boosted ensemble of small trees scores every candidate from features of its
format and of the text around it. All features have few values, so the training set of any corpus collapses, by one
grouped count over all its candidates, to at most ``2 ** 11`` cells; the trees are grown on those cells and then
written as one SQL expression. Training labels are distant: a candidate is positive if the base rules accept exactly its span, or if a
cue of its own or of its context speaks for it (``weak``). Base matches are also planted as positives in the form that lacks what
the base rules go by: phones without their plus, addresses with (at). Counts of a cell are damped for training, so that no kind of
candidate is outvoted by another that is more frequent. Thresholds are calibrated on the true counts of cells, without planted
ones, from the other half of the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import stage, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# Formats. Each is the published form, written so that Java's matcher needs neither recursion nor retries: a match starts
# where a run of its first class starts (or at the end of the match before), and inner runs are possessive, which Java walks in a loop.
_MAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
_CARD = r"[0-9](?:[ -]?+[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# High-recall generators of further candidates, by kind.
_WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,10}(?![A-Za-z])",
    "ip": r"(?<![0-9.])[0-9]{1,3} ?[.:] ?[0-9]{1,3} ?[.:] ?[0-9]{1,3} ?[.:] ?[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[ .-]?[0-9]{4,6}[ .-]?[0-9]{4,5}[ .-]?[0-9]{0,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?=[0-9+(])(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
}
_CUES = {
    "email": "mail|contact|write to|correo|adresse|courriel",
    "ip": r"\bip\b|address|host|server|login|from",
    "card": "card|visa|master|amex|credit|payment|carte|tarjeta|karte|iban",
    "phone": "phone|tel|call|mobile|cell|fax|contact|appel|llam|anruf",
}
FEATURES = ("plus", "checks", "length_fits", "cue", "glued_before", "glued_after", "brackets", "separators", "mixed_separators")


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _spans(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<s, e, m>>: start and end in code points, and the text, of leftmost matches one after another.

    Places are sums of what came before. They are added up in blocks of about the root of the number of matches, as an array grows by copying it.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.transform(gaps, F.length), 1, F.size(found)).alias("g"), found.alias("m"))
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    length = lambda x: x["g"] + F.length(x["m"])

    def walk(block: Column, first: Column) -> Column:
        span = lambda at, x: F.struct((at + x["g"]).alias("s"), (at + length(x)).alias("e"), x["m"].alias("m"))
        step = lambda a, x: F.struct((a["at"] + length(x)).alias("at"), F.array_append(a["out"], span(a["at"], x)).alias("out"))
        return F.aggregate(block, F.struct(first.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def blocks(p: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(p))).cast("int"))
        return F.transform(F.sequence(F.lit(1), F.size(p), size), lambda i: F.slice(p, i, size))

    def firsts(b: Column) -> Column:
        totals = F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + length(y)))
        return F.aggregate(totals, F.array(F.lit(0)), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))

    joined = lambda b: _let(firsts(b), lambda at: F.flatten(F.transform(b, lambda x, i: walk(x, F.get(at, i)))))
    return F.when(guard, _let(pairs, lambda p: F.when(F.size(p) > 0, _let(blocks(p), joined)).otherwise(none))).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.expr("array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)")
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(doubled, c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(m: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _features(kind: str, x: Column, before: Column, after: Column) -> dict[str, Column]:
    m = x["m"]
    n, digits = F.length(_digits(m)), _digits(m)
    checks = {"email": m.contains("@"), "ip": _octets(m), "card": F.when(n.between(12, 19), luhn(digits)).otherwise(False), "phone": ~digits.rlike("^(.)\\1+$")}[kind]
    fits = {"email": F.length(m) <= 64, "ip": n.between(4, 12), "card": n.between(13, 19), "phone": n.between(9, 15)}[kind]
    marks = F.regexp_replace(m, "[A-Za-z0-9]", "")
    return {
        "plus": m.startswith("+") | m.startswith("00"),
        "checks": checks,
        "length_fits": fits,
        "cue": F.lower(before).rlike(_CUES[kind]),
        "glued_before": before.rlike(r"[\p{L}\p{N}_=/.#-]$"),
        "glued_after": after.rlike(r"^[\p{L}\p{N}_=/#-]"),
        "brackets": m.rlike(r"[(\[]"),
        "separators": F.length(marks) > 0,
        "mixed_separators": F.size(F.array_distinct(F.split(marks, ""))) > 1,
    }


def _candidates(kind: str, text: Column, guard: Column, base: Column) -> Column:
    """Wide matches and base ones, with a cell number made of the kind and the features, and whether the base rules accept the span."""
    both = F.array_distinct(F.concat(_spans(text, _WIDE[kind], guard), base))

    def cell(x: Column) -> Column:
        # the neighbourhood is cut out once for each candidate; texts without one never get here
        before = F.substring(text, F.greatest(F.lit(1), x["s"] - 23), F.least(F.lit(24), x["s"]))
        flags = _features(kind, x, before, F.substring(text, x["e"] + 1, F.lit(1)))
        code = F.lit(KINDS.index(kind) << len(FEATURES))
        for i, name in enumerate(FEATURES):
            code = code + F.when(flags[name], 1 << i).otherwise(0)
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), code.alias("cell"), F.exists(base, lambda b: (b["s"] == x["s"]) & (b["e"] == x["e"])).alias("is_base"))

    return F.transform(both, cell)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of k, s, e by start, then kind) and candidates of whole texts."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("t"))
    text = F.col("t")
    digits = text.rlike("[0-9]")
    guards = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": digits, "phone": text.contains("+")}
    wide = {"email": text.contains("@") | text.contains("(at)") | text.contains("[at]"), "ip": text.rlike("[0-9][.:]"), "card": text.rlike("[0-9]{4}"), "phone": text.rlike("[0-9]{3}")}
    found = {"email": _spans(text, _MAIL, guards["email"]), "ip": _spans(text, _IP, guards["ip"]), "card": _spans(text, _CARD, digits), "phone": _spans(text, _PHONE, guards["phone"])}
    valid = lambda kind: lambda x: _valid(kind, x["m"])
    rows = rows.select("doc_id", "t", *[F.filter(found[k], valid(k)).alias(f"base_{k}") for k in KINDS])
    plain = lambda k: F.transform(F.col(f"base_{k}"), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e")))
    return rows.select(
        "doc_id",
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.concat(*map(plain, KINDS))).alias("base"),
        F.concat(*[_candidates(k, text, wide[k], F.col(f"base_{k}")) for k in KINDS]).alias("candidates"),
    )


class BoostedTrees:
    """Logistic gradient boosting of trees of depth two over flags, grown on counted cells."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, smooth: float = 1.0) -> None:
        self.rounds, self.rate, self.smooth = rounds, rate, smooth
        self.flags = len(FEATURES) + len(KINDS)
        self.start = 0.0
        self.trees: list[tuple] = []

    def _flag(self, cell: int, i: int) -> bool:
        kind = cell >> len(FEATURES)
        return bool(cell >> i & 1) if i < len(FEATURES) else kind == i - len(FEATURES)

    def fit(self, cells: dict[int, tuple[int, int]]) -> BoostedTrees:
        """cells: number -> (positive, negative) candidates."""
        pos, neg = (sum(c[i] for c in cells.values()) for i in (0, 1))
        self.start = math.log((pos + 1) / (neg + 1))
        score = dict.fromkeys(cells, self.start)
        for _ in range(self.rounds):
            gradient = {}
            for c, (p, n) in cells.items():
                at = 1 / (1 + math.exp(-score[c]))
                gradient[c] = (p * (1 - at) - n * at, (p + n) * at * (1 - at))
            tree = self._grow(gradient, list(cells), 2)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)
            for c in cells:
                score[c] += self._value(tree, c)
        return self

    def _grow(self, gradient: dict, cells: list[int], depth: int):
        g, h = (sum(gradient[c][i] for c in cells) for i in (0, 1))
        value = self.rate * g / (h + self.smooth)
        best, split = g * g / (h + self.smooth) + 1e-9, None
        for i in range(self.flags if depth else 0):
            sides = [0.0, 0.0], [0.0, 0.0]
            for c in cells:
                side = sides[self._flag(c, i)]
                side[0] += gradient[c][0]
                side[1] += gradient[c][1]
            gain = sum(a * a / (b + self.smooth) for a, b in sides)
            if gain > best:
                best, split = gain, i
        if split is None:
            return value
        parts = [], []
        for c in cells:
            parts[self._flag(c, split)].append(c)
        return (split, *(self._grow(gradient, p, depth - 1) for p in parts))

    def _value(self, tree, cell: int) -> float:
        while isinstance(tree, tuple):
            tree = tree[1 + self._flag(cell, tree[0])]
        return tree

    def score(self, cell: int) -> float:
        return self.start + sum(self._value(t, cell) for t in self.trees)

    def sql(self, cell: str) -> str:
        """The same score as one SQL expression."""

        def branch(tree) -> str:
            if not isinstance(tree, tuple):
                return repr(float(tree)) + "D"
            i = tree[0]
            test = f"({cell} & {1 << i}) <> 0" if i < len(FEATURES) else f"shiftright({cell}, {len(FEATURES)}) = {i - len(FEATURES)}"
            return f"IF({test}, {branch(tree[2])}, {branch(tree[1])})"

        return " + ".join([f"{float(self.start)!r}D", *map(branch, self.trees)])


def _bit(name: str) -> int:
    return 1 << FEATURES.index(name)


def weak(cell: int) -> bool:
    """Whether a candidate that isn't a base match counts as positive: whole, of a fitting length, and with a cue."""
    kind, has = KINDS[cell >> len(FEATURES)], lambda name: bool(cell & _bit(name))
    if not has("length_fits") or has("glued_before") or has("glued_after"):
        return False
    if kind == "email":  # (at) is a cue of its own
        return has("cue") or (has("brackets") and not has("checks"))
    return kind in ("card", "phone") and has("cue") and has("checks")


def planted(cell: int) -> int:
    """The cell of a base match once its plus is left out or its @ is written (at); the cell itself for other kinds."""
    kind = KINDS[cell >> len(FEATURES)]
    if kind == "phone":
        return cell & ~_bit("plus")
    return cell & ~_bit("checks") | _bit("brackets") | _bit("separators") | _bit("mixed_separators") if kind == "email" else cell


def labelled(counts: list[tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
    """(cell, base, other) counts as cell -> (positive, negative)."""
    return {c: (p + n, 0) if weak(c) else (p, n) for c, p, n in counts}


def training(counts: list[tuple[int, int, int]], most: int = 200) -> dict[int, tuple[float, float]]:
    """Labelled counts with the planted ones, each cell scaled to at most ``most`` candidates."""
    cells: dict[int, tuple[float, float]] = dict(labelled(counts))
    for c, base, _ in counts:
        if base and (to := planted(c)) != c:
            p, n = cells.get(to, (0, 0))
            cells[to] = (p + base, n)
    return {c: (p * min(1, most / (p + n)), n * min(1, most / (p + n))) for c, (p, n) in cells.items()}


def threshold(scored: list[tuple[float, int, int]], precision: float) -> float:
    """The lowest score from which on, over (score, positive, negative) counts, at least ``precision`` are positive."""
    best, pos, neg = math.inf, 0, 0
    for score, p, n in sorted(scored, reverse=True):
        pos, neg = pos + p, neg + n
        if pos + neg and pos / (pos + neg) >= precision:
            best = score
    return best


def personal_data(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base, spans, text_sha256.

    ``base`` and ``spans`` are arrays of (s, k, e): start, index of the kind in KINDS, end; code points of the whole text,
    end exclusive. ``spans`` has every base span and, of the candidates that the trees score at or above the kind's
    threshold, those that overlap no base span. Null texts count as empty and have no spans. Rows without a doc_id
    take no part; repeated rows are returned as often. Without candidates no tree is grown. Other columns are not read, whatever their names; texts of any
    length are searched to their end. Of overlapping candidates of one kind that score high enough, all are spans. An empty table gives an empty result.
    """
    found = stage(marked(docs), "candidates")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    counts = found.select(half.alias("half"), F.explode("candidates").alias("c")).groupBy("half", "c.cell").agg(F.count_if("c.is_base").alias("p"), F.count_if(~F.col("c.is_base")).alias("n")).collect()  # at most 2 * 2 ** 11 rows
    by_half = [[(c.cell, c.p, c.n) for c in counts if c.half == h] for h in (0, 1)]
    fit, held = training(by_half[0]), labelled(by_half[1])
    trees = BoostedTrees().fit(fit) if fit else None
    chosen = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    if trees:
        # a little lower, as SQL adds up the trees in another order
        least = [threshold([(trees.score(c), p, n) for c, (p, n) in held.items() if c >> len(FEATURES) == k], precision) - 1e-9 for k in range(len(KINDS))]
        score = f"{trees.sql('c.cell')} >= element_at(array({', '.join(f'{x!r}D' if math.isfinite(x) else 'double(\"Infinity\")' for x in least)}), c.k + 1)"
        free = "NOT exists(base, b -> b.s < c.e AND c.s < b.e)"
        chosen = F.expr(f"transform(filter(candidates, c -> NOT c.is_base AND {free} AND {score}), c -> named_struct('s', c.s, 'k', c.k, 'e', c.e))")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.array_sort(F.array_distinct(F.concat("base", chosen))).alias("spans"), "text_sha256")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; where spans overlap, the first to start is replaced.

    found: what ``personal_data`` says of the same documents. Each row of ``docs`` with a doc_id comes back once, with the spans of its own text, however
    often the doc_id is there. Other columns of ``docs`` are not read.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    pairs = texts.join(found.select("doc_id", "text_sha256", "spans").dropDuplicates(["doc_id", "text_sha256"]), ["doc_id", "text_sha256"])
    names = ", ".join(f"'[{k}]'" for k in KINDS)
    walk = F.expr(
        f"aggregate(spans, named_struct('at', 0, 'out', ''), (a, x) -> IF(x.s < a.at, a, named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), element_at(array({names}), x.k + 1)))), "
        "a -> concat(a.out, substring(text, a.at + 1)))"
    )
    return pairs.select("doc_id", walk.alias("text"))
