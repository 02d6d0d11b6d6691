"""Personal data by candidate generation and gradient boosting, in DataFrame functions only.

Generators propose spans of five kinds (email, ip, card, phone, secret): one strict generator for each of the first four,
whose matches either pass their check (base spans, always kept) or fail it, and one loose
generator a kind with high recall (obfuscated addresses, groups of digits, colon-separated hexadecimal, long runs of letters and digits).
Proposals overlap freely.  Each has a few small discrete features of its format and context.

Boosted trees of depth two are fitted to the counts of feature vectors, which Spark sums over all
documents; there are at most some thousand vectors, whatever the input.  Nobody has labelled the spans, so labels are weak.  What passed a strict check is
personal data, so each base span is written in the forms in which people hide it (``jane (at) site (dot) org``, ``10[.]0[.]0[.]1``, an address in
hexadecimal groups, a card in dotted groups, a phone without its plus), where it stands and behind an announcing word: positive examples.  The same forms of a span
that is made wrong first (an octet too large, another last digit, a number for a domain), and look-alikes made from it, are negative.  Natural loose matches count as they are: positive if they overlap a
base span of their kind, if their digits pass the card check, if they write "at" or "dot" in brackets, or if a word that announces the kind
stands before them and they pass a check of their own; negative otherwise.  So that no one feature repeats its label, each example is counted
three times: as it is, with the announcing word hidden, and with its marks hidden.  Thresholds are calibrated for each kind on the examples that
could be added, hidden forms and natural ones, each scored by trees that the other folds of documents fit: the least margin at which the precision, at the lower end of its error, is ``PRECISION``.  Those above are added.

Proposals are written without their text: features, places and the features of their hidden forms.

A text is split and matched by the same expression, so a span's start is the sum of the lengths before it; the
sums run in a window over small rows.  Expressions take time linear in the text: runs are
possessive and start only where a run starts.

Defined cases: a null text counts as empty and has no spans; a null id is kept; repeated rows each give a row;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit.llm.common import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)

# The contract's expressions, rewritten to take linear time.
# \G: a match may start right after another within a run; else only where a run of its first class starts.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![ -](?![0-9]))[0-9 -])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
AT, DOT = r"(?: ?(?:@|[(\[{] ?(?i:at) ?[)\]}]) ?| (?i:at) )", r"(?:\.| ?[(\[{] ?(?:\.|(?i:dot)) ?[)\]}] ?| (?i:dot) )"
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}+",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){3,7}(?![0-9A-Za-z:])|(?<![0-9])[0-9]{1,3}+(?: ?[(\[](?:\.|dot)[)\]] ?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9.-])[0-9]{4}[ .-]?[0-9]{4,6}[ .-]?[0-9]{4,5}[ .-]?[0-9]{0,4}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?![0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]))(?:\(?[0-9]{2,4}\)?[ ./-]{1,2})?[0-9]{3,4}[ ./-][0-9]{3,4}(?:[ ./-][0-9]{2,4})?(?![0-9])|(?<![0-9+.-])\(?0[0-9]{1,4}\)?[ ./-][0-9]{5,8}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_@])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
}
#: A text without a match of this has none of the generator; finding that out is cheaper than the expression.
NEEDS = {
    ("email", "strict"): "@", ("ip", "strict"): r"[0-9]\.[0-9]", ("card", "strict"): "[0-9]", ("phone", "strict"): r"\+[0-9]",
    ("email", "loose"): rf"@|[(\[{{] ?(?i:at) ?[)\]}}]| (?i:at) [A-Za-z0-9-]{{1,63}}+(?:\.[A-Za-z]| ?[(\[{{] ?(?:\.|(?i:dot))| (?i:dot) )",
    ("ip", "loose"): r"[0-9A-Fa-f]:{1,2}[0-9A-Fa-f]|[0-9] ?[(\[](?:\.|dot)[)\]]", ("card", "loose"): "[0-9]{4}", ("phone", "loose"): r"[0-9]{3}[ ./-][0-9]{3}|0[0-9]{1,4}\)?[ ./-][0-9]{5}",
    ("secret", "loose"): "[A-Za-z0-9_+/-]{16}|-----BEGIN ",
}
_START, _BEFORE = r"(?i)(?<![A-Za-z0-9_À-ɏ])(?:", r")\W{0,6}(?:\w{1,8}\W{1,3}){0,2}$"
ANNOUNCE = {
    "email": r"(?i)(?:e-?mail|mail|contact|write to|correo|courriel" + _BEFORE,
    "ip": _START + r"ipv?[46]?|host|addr(?:ess)?|server" + _BEFORE,
    "card": _START + r"cards?|visa|mastercard|amex|carte|karte|tarjeta|account|konto|cuenta|compte" + _BEFORE,
    "phone": _START + r"tel|telephone|phone|call|mobile|cell|fax|tfno|telefon|teléfono|téléphone" + _BEFORE,
    "secret": r"(?i)(?:secret|token|passw(?:or)?d|pwd|key|auth|bearer|credentials?|clave|schlüssel|jeton" + _BEFORE,
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
VALID_IP = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
CONTEXT = 32
PRECISION = 0.98
#: Standard errors that a held-out precision is taken down by (Wilson's bound).
ERRORS = 0.5
ROUNDS, RATE = 40, 0.3
#: Folds of documents: each is scored by trees that the others fit, and thresholds rest on these scores.
FOLDS = 4
#: Feature columns, each a small number; ``announced`` and ``marks`` have a value that says nothing.
FEATURES = ("kind", "strict", "digits", "length", "groups", "before", "after", "announced", "marks", "dots", "letters", "sound")
HIDDEN = {"announced": 2, "marks": 4}
EMPTY = "array<struct<kind:int,strict:int,k:int,gap:int,match:string,left:string,right:string>>"


def _proposals(text: Column, kind: str, source: str) -> Column:
    """Array of structs: one for each match of the generator, with the gap before it and its context."""
    pattern = (STRICT if source == "strict" else LOOSE)[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kinds = F.lit(KINDS.index(kind))
    # the gaps before and behind each match stand beside it
    both = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("g"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(1))).alias("h"))
    rows = F.transform(both, lambda x, k: F.struct(kinds.alias("kind"), F.lit(int(source == "strict")).alias("strict"), k.alias("k"), F.length(x["g"]).alias("gap"), x["m"].alias("match"), F.right(x["g"], F.lit(CONTEXT)).alias("left"), F.left(x["h"], F.lit(1)).alias("right")))
    need = NEEDS[kind, source]
    test = F.contains(text, F.lit(need)) if need == "@" else text.rlike(need)
    return F.when(test, rows).otherwise(F.array().cast(EMPTY))


def _luhn(digits: Column) -> Column:
    """Whether a number of 12 to 19 digits passes; false for others, which are not looked into."""
    of = F.when(F.length(digits).between(12, 19), digits)
    each = F.transform(F.sequence(F.lit(0), F.length(of) - 1), lambda i: (F.substring(of, -(i + 1), F.lit(1)).cast("int") * (1 + i % 2)))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0, F.lit(False))


def _klass(c: Column) -> Column:
    """Class of a neighbouring character: none, blank, letter, digit, other."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[A-Za-z]"), 2).when(c.rlike(r"[0-9]"), 3).otherwise(4)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def format_features(m: Column, kind: Column) -> list[Column]:
    """Features of a match alone."""
    marks = F.when((kind == CARD) & _luhn(_digits(m)), 3).when((kind <= IP) & m.rlike(r"[(\[{] ?(?:\.|(?i:at|dot)) ?[)\]}]"), 2).when(kind == EMAIL, m.rlike("@| (?i:dot) ").cast("int")).otherwise(F.contains(m, F.lit("+")).cast("int"))
    return [
        F.least(F.floor(F.length(_digits(m)) / 3), F.lit(7)).cast("int").alias("digits"),
        F.least(F.floor(F.length(m) / 6), F.lit(8)).cast("int").alias("length"),
        F.least(F.size(F.split(F.regexp_replace(m, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")), F.lit(5)).cast("int").alias("groups"),
        marks.cast("int").alias("marks"),
        F.least(F.length(F.regexp_replace(m, "[^.]", "")), F.lit(3)).cast("int").alias("dots"),
        # none, hexadecimal digits, lower case, capitals, both
        F.when(~m.rlike("[A-Za-z]"), 0).when(m.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 1).when(~m.rlike("[A-Z]"), 2).when(~m.rlike("[a-z]"), 3).otherwise(4).alias("letters"),
        F.coalesce(_sound(m, kind), F.lit(False)).cast("int").alias("sound"),
    ]


def _fits(m: Column, kind: Column) -> Column:
    """Whether an announced match can be what was announced."""
    digits = F.length(_digits(m))
    return F.when(kind == PHONE, digits.between(7, 15)).when(kind == CARD, digits.between(12, 19)).when(kind == SECRET, F.size(F.array_distinct(F.split(m, ""))) >= 8).otherwise(True)


def _sound(m: Column, kind: Column) -> Column:
    """Whether a match, read without its disguise, can be what its kind says."""
    plain = F.regexp_replace(m, r" ?[(\[](?:\.|dot)[)\]] ?", ".")
    colons = F.length(F.regexp_replace(m, "[^:]", ""))
    return (
        F.when(kind == EMAIL, m.rlike(r"[^A-Za-z][A-Za-z]{2,24}$")).when(kind == IP, F.when(colons > 0, (colons == 7) | F.contains(m, F.lit("::"))).otherwise(plain.rlike(VALID_IP)))
        .when(kind == CARD, _luhn(_digits(m))).when(kind == PHONE, F.length(_digits(m)).between(9, 15)).otherwise(F.size(F.array_distinct(F.split(m, ""))) >= 8)
    )


def _forms(m: Column, kind: Column) -> Column:
    """A strict match of a kind as people write it to be overlooked; a secret in other alphabets and shorter."""
    # a short address beside the one that is there, so that lengths teach nothing
    short = F.concat(F.left(m, F.lit(3)), F.lit("@"), F.regexp_extract(m, r"[A-Za-z0-9-]+\.[A-Za-z0-9-]+$", 0))
    both = lambda a, b: [F.regexp_replace(F.regexp_replace(x, "@", a), r"\.(?=[A-Za-z0-9-]+$)", b) for x in (m, short)]
    d = _digits(m)
    last = lambda a, n: F.substring(d, -a, n)
    dotted = F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1.")
    return (
        F.when(kind == EMAIL, F.array(*both(" (at) ", " (dot) "), *both(" [at] ", "[.]"), *both(" at ", " dot ")))
        .when(kind == IP, F.array(F.regexp_replace(m, r"\.", "[.]"), F.regexp_replace(m, r"\.", " (dot) "), F.concat(F.lit("2001:db8::"), F.regexp_replace(m, r"\.", ":"))))
        .when(kind == CARD, F.array(dotted, dotted))
        .when((kind == PHONE) & (F.length(d) >= 10), F.array(F.concat(F.lit("("), last(10, 3), F.lit(") "), last(7, 3), F.lit("-"), last(4, 4)), F.concat_ws("-", last(10, 3), last(7, 3), last(4, 4)), F.concat(F.lit("0"), last(10, 2), F.lit(" "), last(8, 8))))
        .when(kind == SECRET, F.array(F.upper(m), F.left(F.upper(m), F.lit(22)), F.concat(m, F.left(m, F.lit(12))), F.translate(m, "ace135", "XkQzPm"), F.left(F.translate(m, "bdf024", "RtWvYn"), F.lit(30))))
        .otherwise(F.array().cast("array<string>"))
    )


def _spoilt(m: Column, kind: Column) -> Column:
    """A strict match made wrong."""
    return (
        F.when(kind == EMAIL, F.regexp_replace(m, r"\.[A-Za-z0-9-]+$", ".2024")).when(kind == IP, F.concat(F.lit("7"), F.lpad(F.regexp_extract(m, "^[0-9]+", 0), 2, "1"), F.regexp_extract(m, r"\..*$", 0)))
        .when(kind == CARD, F.concat(F.substring(m, 1, F.length(m) - 1), F.translate(F.right(m, F.lit(1)), "0123456789", "1234567890"))).otherwise(m)
    )


def _wrong_forms(m: Column, kind: Column) -> Column:
    """The first forms of a spoilt match, and what looks alike: a site that someone looks at, numbers like a time of day, a long word with a year."""
    word = F.translate(m, "0123456789", "aeioutnrsl")
    like = (
        F.when(kind == EMAIL, F.array(F.concat(F.lit("look at "), F.regexp_extract(m, "@(.*)$", 1)), F.concat(F.lit("bits at "), F.regexp_extract(m, r"[A-Za-z0-9-]+\.[A-Za-z0-9-]+$", 0))))
        .when(kind == IP, F.array(F.regexp_replace(m, r"\.", ":"))).when(kind == SECRET, F.array(F.concat(F.left(word, F.lit(30)), F.lit("2024")), F.concat(F.initcap(F.left(word, F.lit(21))), F.lit("1")), F.concat(F.initcap(word), F.lit("2024")))).otherwise(F.array().cast("array<string>"))
    )
    spoilt = F.when(kind.isin(EMAIL, IP, CARD), F.slice(_forms(_spoilt(m, kind), kind), 1, 2)).otherwise(F.array().cast("array<string>"))
    return F.concat(spoilt, like)


def _variants(m: Column, kind: Column, known: Column) -> Column:
    """A match itself, with a null label, and the hidden forms and look-alikes of one that is ``known`` to be personal data, with theirs."""
    of = lambda forms, y: F.transform(forms, lambda x: F.struct(x.alias("match"), F.lit(y).cast("int").alias("y")))
    own = F.array(F.struct(m.alias("match"), F.lit(None).cast("int").alias("y")))
    return F.when(known, F.concat(own, of(_forms(m, kind), 1), of(_wrong_forms(m, kind), 0))).otherwise(own)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All proposals ``rid, doc_id, kind, start, end, base, features..``, and a row with a null kind for a text without any; rows with a label ``y`` are forms of a proposal.  No text of a proposal is kept."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text")).withColumn("rid", F.monotonically_increasing_id())
    parts = [_proposals(F.col("text"), kind, source) for kind, source in NEEDS]
    found = docs.select("rid", "doc_id", F.explode_outer(F.concat(*parts)).alias("c"))
    rows = found.select("rid", "doc_id", "c.*").repartition("rid")
    size = F.length("match")
    own = Window.partitionBy("rid", "kind", "strict").orderBy("k")
    end = F.sum(F.col("gap") + size).over(own)
    m, kind = F.col("match"), F.col("kind")
    passes = F.when(kind == EMAIL, True).when(kind == IP, m.rlike(VALID_IP)).when(kind == CARD, _luhn(_digits(m))).otherwise(F.length(_digits(m)).between(9, 15))
    announced = reduce(lambda a, k: F.when(kind == k, F.col("left").rlike(ANNOUNCE[KINDS[k]])).otherwise(a), range(len(KINDS)), F.lit(False))
    base = F.coalesce((F.col("strict") == 1) & passes, F.lit(False))
    placed = rows.select(
        "rid", "doc_id", "kind", "strict", (end - size).cast("long").alias("start"), end.cast("long").alias("end"), base.alias("base"), "match",
        _klass(F.right("left", F.lit(1))).cast("int").alias("before"), _klass(F.col("right")).cast("int").alias("after"), announced.cast("int").alias("announced"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"),
    )
    # base spans of the kind that start no later and reach in, or start later and before the end
    same = Window.partitionBy("rid", "kind")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(same.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(same.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    overlap = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    known = F.col("base") | ((kind == SECRET) & (F.col("announced") == 1) & _fits(m, kind))
    every = placed.withColumn("overlap", overlap).withColumn("v", F.explode(_variants(m, kind, F.coalesce(known, F.lit(False))))).drop("match")
    own = F.col("v.match")
    return every.withColumn("y", F.col("v.y")).withColumn("fits", _fits(own, kind)).select(*(c for c in every.columns if c != "v"), "y", "fits", *format_features(own, kind))


Tree = tuple  # (feature, cut, low, high); a leaf is a float


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rest: float = 1.0) -> tuple[int, int] | None:
    """The (feature, cut) of most gain for rows of small whole numbers, gradients and hessians, or None."""
    gain = lambda a, b: a * a / (b + rest)
    best, most = None, 1e-6
    for f in range(x.shape[1]) if len(x) else ():
        low_g, low_h = (np.cumsum(np.bincount(x[:, f], w)) for w in (g, h))
        own = np.bincount(x[:, f]) > 0
        won = np.where(own, gain(low_g, low_h) + gain(low_g[-1] - low_g, low_h[-1] - low_h) - gain(low_g[-1], low_h[-1]), 0.0)[:-1]
        if len(won) and won.max() > most + 1e-12:
            best, most = (f, int(won.argmax())), float(won.max())
    return best


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    split = _best_split(x, g, h) if depth else None
    if split is None:
        return RATE * float(g.sum()) / (float(h.sum()) + 1.0)
    f, cut = split
    low = x[:, f] <= cut
    return (f, cut, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _value(tree, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(counts: list[tuple[tuple, int, float]], rounds: int = ROUNDS, depth: int = 2) -> list:
    """Trees for (features, label, weight) by second-order gradient boosting of the logistic loss."""
    if not counts:
        return []
    x = np.array([c[0] for c in counts], np.int64)
    y, w = (np.array([c[k] for c in counts], np.float64) for k in (1, 2))
    trees: list = []
    total = np.zeros(len(counts))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        trees.append(_grow(x, w * (y - p), w * p * (1 - p), depth))
        total += [_value(trees[-1], r) for r in x.tolist()]
    return trees


def thresholds(scored: list[tuple[int, float, int, float]], precision: float = PRECISION) -> dict[int, float]:
    """For each kind the least margin at and above which the precision holds, at the lower end of its error; infinite if there is none.  scored: (kind, held-out margin, label, weight)."""

    def least(good: float, n: float) -> float:
        p, z = good / n, ERRORS * ERRORS / n
        return (p + z / 2 - math.sqrt(z * (p * (1 - p) + z / 4))) / (1 + z)

    out = {}
    for kind in range(len(KINDS)):
        own = sorted(((score, y, w) for k, score, y, w in scored if k == kind), reverse=True)
        best, good, all_ = math.inf, 0.0, 0.0
        for k, (score, y, w) in enumerate(own):
            good, all_ = good + w * y, all_ + w
            last = k + 1 == len(own) or own[k + 1][0] < score
            if last and all_ and least(good, all_) >= precision:
                best = score
        out[kind] = best
    return out


def margin(trees: list) -> Column:
    """The trees as one expression over the feature columns."""

    def column(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, cut, low, high = tree
        return F.when(F.col(FEATURES[f]) <= cut, column(low)).otherwise(column(high))

    return reduce(lambda a, t: a + column(t), trees, F.lit(0.0))


def examples(proposals: DataFrame) -> DataFrame:
    """Features, label ``y``, ``fold``, and ``free``: whether the example is one that could be added (a hidden form, or a natural match that overlaps no base span)."""
    c = F.col
    label = c("overlap") | (c("marks").isin(2, 3)) | ((c("announced") == 1) & c("fits"))
    natural = proposals.where("strict = 0 and y is null").select(*FEATURES, label.cast("int").alias("y"), "fold", (~c("overlap")).alias("free"))
    # forms count with and without an announcing word; a secret is one by its announcement
    told = F.explode(F.when(c("kind") == SECRET, F.array("y")).otherwise(F.array(F.lit(0), F.lit(1)))).alias("told")
    hidden = proposals.where("y is not null").select("*", told).withColumn("announced", c("told")).withColumn("strict", F.lit(0))
    return natural.unionByName(hidden.select(*FEATURES, "y", "fold", F.lit(True).alias("free")))


def fit(proposals: DataFrame) -> tuple[list, dict[int, float]]:
    """Trees and thresholds from the weak labels of all proposals."""
    rows = examples(proposals.where(F.col("kind").isNotNull())).groupBy(*FEATURES, "y", "fold", "free").count().collect()  # distinct small vectors
    seen: dict[int, dict] = {k: {} for k in range(FOLDS)}
    addable: list = []
    for r in rows:
        x, y, n = tuple(int(r[f]) for f in FEATURES), int(r["y"]), float(r["count"])
        if r["free"]:
            addable.append((int(r["fold"]), x, y, n))
        for hidden in (None, *HIDDEN):
            veiled = tuple(HIDDEN[f] if f == hidden else v for f, v in zip(FEATURES, x, strict=True))
            own = seen[int(r["fold"])]
            own[veiled, y] = own.get((veiled, y), 0.0) + n

    def trained(folds) -> list:
        total: dict = {}
        for k in folds:
            for at, n in seen[k].items():
                total[at] = total.get(at, 0.0) + n
        return boost([(x, y, n) for (x, y), n in sorted(total.items())])

    scored = []
    for k in range(FOLDS):
        trees = trained(j for j in range(FOLDS) if j != k)
        scored += [(x[0], sum(_value(t, x) for t in trees), y, n) for fold, x, y, n in addable if fold == k]
    return trained(range(FOLDS)), thresholds(scored)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[list, dict[int, float]] | None = None) -> DataFrame:
    """``rid, doc_id, base, all``: arrays of (start, kind number, end), in order.  The ``model`` of :func:`fit` is that of the same table by default."""
    rows = materialize(candidates(df, id_col, text_col), "pii-proposals")
    trees, least = model or fit(rows)
    score = margin(trees)  # Spark may add constants in another order
    limit = reduce(lambda a, k: F.when(F.col("kind") == k, F.lit(float(least[k]))).otherwise(a), range(len(KINDS)), F.lit(float("inf")))
    picked = rows.where("y is null").select("rid", "doc_id", "kind", "start", "end", "base", (~F.col("base") & (F.col("strict") == 0) & (score >= limit - 1e-9)).alias("wanted")).where("kind is null or base or wanted")
    order = Window.partitionBy("rid").orderBy("start", "end", "kind")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    stay = picked.withColumn("added", F.coalesce(F.col("wanted") & clear, F.lit(False)))
    span = F.struct("start", "kind", "end")
    found = stay.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("base") | F.col("added"), span))).alias("all"))
    # a text all of whose proposals were dropped has no row left
    every = rows.groupBy("rid").agg(F.first("doc_id").alias("doc_id"))
    none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("end"))), 1, 0)
    return every.join(found.drop("doc_id"), "rid", "left").select("rid", "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("all", none).alias("all"))


def _listed(found: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[list, dict[int, float]] | None = None) -> DataFrame:
    """``doc_id``, numbers of base spans ``n_email, n_ip, n_card, n_phone``, ``base_sha256, spans``, and numbers of added ``n_secret, n_added``, and whether a row has any span (``found``), of every row."""
    found = spans(df, id_col, text_col, model)

    def number(spans: str, k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")

    numbers = [number("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:SECRET])]
    added = (F.size("all") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *numbers, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"), number("all", SECRET).alias("n_secret"), added, (F.size("all") > 0).alias("found"))


def redacted(text: Column, found: Column) -> Column:
    """``text`` with each of the spans (start, kind, end; in order) replaced by its kind; later overlaps of a span are cut short."""
    names = F.array(*map(F.lit, KINDS))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(
        found, empty,
        lambda a, s: F.struct(
            F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("<"), F.get(names, s["kind"]), F.lit(">"))).otherwise("")).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    return F.concat(done["out"], F.substring(text, done["at"].cast("int") + 1, F.length(text)))
