"""Personal data by weak supervision, in column expressions alone.

Base spans follow four patterns and their checks. Beyond them, looser patterns propose candidate spans; four labelers vote
on each (or abstain): a format labeler, a gazetteer labeler (top-level domains, card issuers, calling codes, reserved
networks), a context labeler (words before the span) and an edge labeler (what touches it). Candidates are counted by kind,
votes and features, which has a bounded number of rows however large the corpus is; from these counts expectation-
maximisation estimates how reliable each labeler is, and a logistic span classifier is fitted to the resulting
probabilities. Candidates that it accepts, and that touch no base span, are added.

Positions come from the lengths of the matches and of the text between them; rows are never exploded or shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

KINDS = ("email", "ip", "card", "phone")

# Base patterns. Possessive forms and the conditions in front leave the matches as they are and keep them linear: a local
# part, a run of digits and a card number begin where such a run begins or the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Candidates: anything around an @; written forms of addresses, phone numbers and cards, each on its own, as a base pattern
#: may run over two that stand side by side and then fail; and other runs of digits with the usual separators.
CANDIDATE = "|".join((
    r"(?<![^\s@<>\"'])[^\s@<>\"']{1,128}+@[^\s@<>\"']{1,255}+",
    r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    r"(?<![0-9])[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    r"(?<![0-9])(?:\+|\()?[0-9](?:[ ().-]{0,3}[0-9]){6,}+",
))

# Gazetteers and context words.
TOP_LEVEL = ("com", "net", "org", "edu", "gov", "mil", "int", "info", "io", "co", "biz", "eu", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "be", "pt", "us", "ca", "mx", "br", "ar", "au", "jp", "cn", "in")
RESERVED_NETS = ("0.", "127.", "255.", "224.", "239.")
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = {
    "email": "mail|contact|write to|schreib|écri|correo|kontakt",
    "ip": r"\bip\b|host|server|address|adresse|dirección|login from",
    "card": "card|visa|mastercard|amex|carte|karte|tarjeta|payment|credit|kredit",
    "phone": r"phone|\bcall|\btel\b|tel[.:]|telefon|téléphone|teléfono|mobile|mobil|fax|handy",
}
AGAINST = r"(?:key|token|secret|hash|sha|md5|uuid|id|isbn|version|serial|order|no\.?|nr\.?|#|=)[\s:=\"']*$"

_BLOCK = 128


def _zipped(text: Column, pattern: str) -> Column:
    """Matches with the text before and after each: array of (gap, match, after)."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.transform(F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"), F.slice(gaps, 2, F.size(matches)).alias("a")), lambda x: x)


def _started(zipped: Column) -> Column:
    """(start, end, m, g, a) for zipped matches. Lengths are summed up within blocks, and blocks' sums over blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / _BLOCK)), lambda i: F.slice(zipped, (i * _BLOCK + 1).cast("int"), _BLOCK))
    long = lambda c: F.length(c).cast("long")

    def inside(block: Column, ahead: Column) -> Column:
        first = F.struct(ahead.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,m:string,g:string,a:string>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + long(x["g"])
            end = start + long(x["m"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["g"].alias("g"), x["a"].alias("a")))).alias("out"))

        return F.aggregate(block, first, step, lambda acc: acc["out"])

    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda acc, x: acc + long(x["g"]) + long(x["m"]))
    none = F.array().cast("array<struct<start:bigint,end:bigint,m:string,g:string,a:string>>")
    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    found = F.aggregate(
        blocks,
        first,
        lambda acc, block: F.struct((acc["at"] + total(block)).alias("at"), F.concat(acc["out"], inside(block, acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(F.size(zipped) > 0, found).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, _doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _doubled(d: Column) -> Column:
    return d * 2 - F.when(d > 4, 9).otherwise(0)


def _valid(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _base_of(kind: str, text: Column) -> Column:
    """Base spans of one kind: array of (start, kind number, end)."""
    sign = {"email": "@", "phone": "+"}.get(kind)
    there = F.contains(text, F.lit(sign)) if sign else text.rlike(BASE[kind])
    spans = F.filter(_started(_zipped(text, BASE[kind])), lambda x: _valid(kind, x["m"]))
    plain = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))
    return F.when(there, plain).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def _candidates(text: Column) -> Column:
    """Candidate spans with votes (1, 0, or -1 to abstain) and features."""
    found = _started(_zipped(text, CANDIDATE))

    def described(x: Column) -> Column:
        m, digits = x["m"], _digits(x["m"])
        n = F.length(digits)
        kind = (
            F.when(F.contains(m, F.lit("@")), 0)
            .when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 1)
            .when(m.startswith("+"), 3)
            .when(n.between(13, 19) & ~m.rlike("[().]"), 2)
            .when(n.between(7, 12) & m.rlike("[ ().-]"), 3)
            .otherwise(-1)
        )
        before, after = F.lower(F.right(x["g"], F.lit(24))), F.left(x["a"], F.lit(1))
        by = lambda make: reduce(lambda rest, k: F.when(kind == k, make(KINDS[k])).otherwise(rest), range(4), F.lit(-1))
        shape = {
            "email": F.when(m.rlike(rf"^{_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"), 1).otherwise(0),
            "ip": F.when(_valid("ip", m), 1).otherwise(0),
            "card": F.when(luhn(digits), 1).otherwise(0),
            "phone": F.when(m.startswith("+") & n.between(10, 15), 1).when(m.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), -1).otherwise(0),
        }
        listed = {
            "email": F.when(F.lower(F.regexp_extract(m, r"\.([A-Za-z]+)[^A-Za-z]*$", 1)).isin(*TOP_LEVEL), 1).otherwise(0),
            "ip": F.when(reduce(lambda a, b: a | b, (m.startswith(net) for net in RESERVED_NETS)), 0).otherwise(1),
            "card": F.when(digits.rlike(CARD_ISSUERS), 1).otherwise(0),
            "phone": F.when(m.rlike(CALLING_CODES), 1).when(m.startswith("+"), 0).otherwise(-1),
        }
        words = by(lambda k: F.when(before.rlike(AGAINST), 0).when(before.rlike(CONTEXT[k]), 1).otherwise(-1))
        edge = F.when(F.right(x["g"], F.lit(1)).rlike(r"[\p{L}\p{N}_=#/\\]") | after.rlike(r"[\p{L}\p{N}_/\\]"), 0).otherwise(-1)
        length = F.when(kind == 0, F.when(F.length(m) > 64, 2).otherwise(0)).otherwise(F.when(n < 10, 0).when(n < 14, 1).otherwise(2))
        votes = [by(lambda k: shape[k]), by(lambda k: listed[k]), words, edge]
        named = [v.cast("int").alias(f"v{i}") for i, v in enumerate(votes)]
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), *named, length.alias("length"), m.rlike("[ ().-]").alias("parted"))

    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,v0:int,v1:int,v2:int,v3:int,length:int,parted:boolean>>")
    some = F.filter(F.transform(found, described), lambda c: c["kind"] >= 0)
    return F.when(text.rlike(r"@|[0-9][ ().-]{0,3}[0-9][ ().-]{0,3}[0-9][ ().-]{0,3}[0-9][ ().-]{0,3}[0-9]"), some).otherwise(none)


_VOTES = [f"v{i}" for i in range(4)]


def counts(docs: DataFrame, text: str = "text") -> list[tuple]:
    """Candidates of the whole corpus, counted by kind, votes and features: at most 4 * 3^4 * 6 rows reach the driver."""
    cells = docs.select(F.explode(_candidates(F.coalesce(F.col(text), F.lit("")))).alias("c")).select("c.kind", *(f"c.{v}" for v in _VOTES), "c.length", "c.parted")
    rows = cells.groupBy("kind", *_VOTES, "length", "parted").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(tuple(r) for r in rows)


def reliabilities(rows: list[tuple], rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over counts: prior by kind, and by labeler the chance of a yes among true and among false spans (abstentions tell
    nothing). Returns them and the probability of each row. Labelers start as better than chance; pseudo-counts keep the
    chances off 0 and 1."""
    kind = np.array([r[0] for r in rows], dtype=int)
    votes = np.array([r[1:5] for r in rows], dtype=int).reshape(-1, 4)
    n = np.array([r[-1] for r in rows], dtype=float)
    prior, yes = np.full(4, 0.5), np.tile([[0.8], [0.2]], (1, 4))
    p = np.zeros(len(rows))
    for _ in range(rounds):
        likely = [np.log(x[kind]) for x in (prior, 1 - prior)]
        for c in (0, 1):
            for j in range(4):
                likely[c] = likely[c] + np.where(votes[:, j] == 1, np.log(yes[c, j]), 0) + np.where(votes[:, j] == 0, np.log(1 - yes[c, j]), 0)
        new = 1 / (1 + np.exp(np.clip(likely[1] - likely[0], -60, 60)))
        for k in range(4):
            prior[k] = (n[kind == k] @ new[kind == k] + 1) / (n[kind == k].sum() + 2)
        for c, weight in ((0, new), (1, 1 - new)):
            for j in range(4):
                said = votes[:, j] >= 0
                yes[c, j] = (n[said] @ (weight[said] * votes[said, j]) + (1.6 if c == 0 else 0.4)) / (n[said] @ weight[said] + 2)
        done = np.abs(new - p).max(initial=0) < 1e-9
        p = new
        if done:
            break
    return prior, yes, p


#: Features of the classifier: kinds, then a yes and a no of each labeler (an abstention is neither), lengths and parts.
_N = 4 + 8 + 3


def _features(row: tuple) -> list[float]:
    kind, *votes = row[:5]
    length, parted = row[5:7]
    return [*(float(kind == k) for k in range(4)), *(float(v == said) for v in votes for said in (1, 0)), float(length == 1), float(length == 2), float(parted)]


def fit(rows: list[tuple], rounds: int = 40, ridge: float = 1.0) -> list[float]:
    """Weights of the logistic span classifier over kinds, votes and shape, fitted to EM's probabilities by Newton's method."""
    x = np.array([_features(r) for r in rows], dtype=float).reshape(-1, _N)
    n, (_, _, p) = np.array([r[-1] for r in rows], dtype=float), reliabilities(rows)
    w = np.zeros(_N)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - q)) - ridge * w
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(_N), slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def train(docs: DataFrame, text: str = "text") -> list[float]:
    return fit(counts(docs, text))


def _accepted(text: Column, base: Column, weights: list[float], least: float) -> Column:
    """Candidates that the classifier accepts and that overlap no base span."""
    limit = float(np.log(least / (1 - least)))

    def score(c: Column) -> Column:
        own = reduce(lambda rest, k: F.when(c["kind"] == k, F.lit(weights[k])).otherwise(rest), range(4), F.lit(0.0))
        votes = reduce(lambda a, b: a + b, (F.when(c[v] == 1, weights[4 + 2 * i]).when(c[v] == 0, weights[5 + 2 * i]).otherwise(0.0) for i, v in enumerate(_VOTES)))
        shape = F.when(c["length"] == 1, weights[12]).when(c["length"] == 2, weights[13]).otherwise(0.0) + F.when(c["parted"], weights[14]).otherwise(0.0)
        return own + votes + shape

    free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    new = F.filter(_candidates(text), lambda c: (score(c) >= limit) & free(c))
    return F.transform(new, lambda c: F.struct(c["start"].alias("start"), c["kind"].cast("int").alias("kind"), c["end"].alias("end")))


def _written(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, weights: list[float] | None = None, text: str = "text", least: float = 0.9, names: tuple[str, str] = ("base_spans", "all_spans")) -> DataFrame:
    """docs with base_spans and all_spans (or columns of other names) added, in place of any columns of these names: arrays of
    (start, kind number, end) in code points, by start, then kind.

    A null text is empty and has none. least is the probability at which a candidate is accepted. Repeated rows and further
    columns pass through; an empty table gives an empty result.
    """
    weights = train(docs, text) if weights is None else weights
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumn(names[0], F.sort_array(F.concat(*(_base_of(k, whole) for k in KINDS))))
    return base.withColumn(names[1], F.sort_array(F.concat(names[0], _accepted(whole, F.col(names[0]), weights, least))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_added: one row for each row of docs."""
    found = find_spans(docs.select("doc_id", "text"))
    number = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(number(k) for k in KINDS), F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"),
        (F.size("all_spans") - F.size("base_spans")).cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame, weights: list[float] | None = None, least: float = 0.9) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; overlapping spans are replaced together, by the first's
    kind. n_chars, where there is one and the text has changed, becomes the new length. Columns stay as they are.

    Replacing a span can part digits that made a neighbour invalid, so that texts that have changed are read once more, by
    the same classifier, from a stored table.
    """
    weights = train(docs) if weights is None else weights
    once = stored(_replaced(docs, weights, least, "_pii_changed"), "redacted")
    again = _replaced(once.where("_pii_changed").drop("_pii_changed"), weights, least, "_pii_changed")
    return once.where("not _pii_changed").unionByName(again).select(*docs.columns)


def _replaced(docs: DataFrame, weights: list[float], least: float, mark: str) -> DataFrame:
    """docs with spans replaced, and a column that says whether there were any."""
    columns = docs.columns
    found = find_spans(docs, weights, least=least, names=("_pii_base", "_pii_all"))
    tag = lambda x: F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), x["kind"] + 1)
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(between, tag(x)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    last = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    some = F.size("_pii_all") > 0
    out = found.withColumn("_pii_text", F.when(some, F.aggregate("_pii_all", first, step, last)).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(some, F.length("_pii_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("_pii_text")).select(*columns, some.alias(mark))
