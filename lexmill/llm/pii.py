"""Personal data by candidate gradient boosting, in DataFrame expressions alone.

Base kinds have fixed patterns and validity rules. Beside them, high-recall generators propose spans that may overlap
(addresses spelled with "at" and "dot", long tokens, digit groups); boosted trees judge each by its format and by the
words before it, and the calibrated threshold of its kind selects it. The trees are fitted on the driver to a generated
set of bounded size, whose features the same expressions compute, and become nested CASE expressions, so that the main
path never leaves the JVM. A part of the set is kept for the thresholds and another, with contexts of its own, for
measuring (`generated`).

Positions: each pattern runs once and sets marks around its matches, so that pieces and matches alternate and running
lengths give code-point offsets. Running values over long arrays are folded in chunks of CHUNK members and carried from
chunk to chunk: work grows with the number of matches, not with its square.
"""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import column, pack, table, unpack

CHUNK = 256
#: Stands around matches; where a text holds it, OTHER takes its place, which no pattern matches either.
MARK, OTHER = "\x01", "\x02"

# Base kinds in order. A match may begin only where no earlier start could have matched (\G: where the
# match before ended), and repeats are possessive; both keep long runs linear and change no match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
BYTE_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

# Generators of further candidates.
AT, DOT = r" ?(?:\(at\)|\[at\]| at ) ?", r"(?:\.| ?(?:\(dot\)|\[dot\]| dot ) ?)"
GENERATORS = {
    "address": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "number": r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
}
# What a text must contain for a pattern to be tried.
HINTS = {"email": "@", "phone": "+", "address": r"(?:[(\[]at[)\]]| at )"}

# Words before a candidate that speak for or against kinds.
CUES = {
    "cue_secret": r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|bearer|auth)[^A-Za-z0-9]{0,6}(?:is)?[^A-Za-z0-9]{0,6}$",
    "cue_phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp)[^A-Za-z0-9]{0,6}(?:me|at|is|us|on)?[^A-Za-z0-9]{0,4}$",
    "cue_person": r"(?i)(?:ssn|social security(?: number)?|passport|national id|tax id|account|iban)[^A-Za-z0-9]{0,6}(?:no|nr|number|is)?[^A-Za-z0-9]{0,6}$",
    "cue_mail": r"(?i)(?:e-?mail|contact|write|reach|mail)[^A-Za-z0-9]{0,6}(?:me|us|to|is)?[^A-Za-z0-9]{0,4}$",
    "cue_record": r"(?i)(?:commit|sha1?|md5|hash|revision|version|order|invoice|isbn|page|file|digest|uuid)[^A-Za-z0-9]{0,6}(?:no|nr|number|id|is)?[^A-Za-z0-9]{0,6}$",
}
FEATURES = ["is_address", "is_secret", "is_number", "length", "digits", "letters", "upper", "others", "switches", "hex_only", "grouped", "dated", "spelled", *CUES]


# ---------------------------------------------------------------- the generated set

# Contexts in which the values of the generated set stand; the second list of each is for measuring only.
SECRET_CONTEXTS = (["token = \"", "secret: ", "password=", "api_key = '", "Authorization: Bearer ", "access key ", "auth=", "pwd: "], ["the token is ", "passwd = \"", "API key: ", "client_secret=\""])
RECORD_CONTEXTS = (["commit ", "sha1 ", "file ", "hash: ", "revision ", "md5 "], ["digest ", "sha ", "uuid "])
PHONE_CONTEXTS = (["phone: ", "call ", "call me at ", "tel. ", "mobile ", "fax "], ["Tel: ", "whatsapp ", "cell ", "phone is "])
PERSON_CONTEXTS = (["SSN ", "social security number ", "passport no ", "account number "], ["IBAN ", "tax id ", "national id "])
NUMBER_CONTEXTS = (["order ", "version ", "page ", "isbn "], ["invoice no ", "order number "])
MAIL_CONTEXTS = (["write to ", "email: ", "contact me ", "reach us "], ["e-mail ", "mail to "])
SYLLABLES = "an be cour de en for ge ha in ka lo men no ou pra qui ra sta ti un ver wen zo".split()


def generated(n: int = 6000, seed: int = 11) -> list[tuple[str, str, int, str]]:
    """n examples (before, value, label, part): values of random letters and digits behind a context and some words of
    random syllables. part is fit, tune (for thresholds) or held (for measuring; with contexts that the others lack)."""
    r = random.Random(seed)
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
    long_word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(9, 18))).ljust(20, "e")
    key = lambda: r.choice([of(hexa, r.choice((32, 40, 64))), of(low + up + dig, r.randint(20, 48)), r.choice(("sk_live_", "ghp_", "xoxb-")) + of(low + up + dig, 26), "AKIA" + of(up + dig, 18)])
    phone = lambda: r.choice([f"{of(dig, 3)}-{of(dig, 3)}-{of(dig, 4)}", f"({of(dig, 3)}) {of(dig, 3)}-{of(dig, 4)}", f"0{of(dig, 2)} {of(dig, 7)}", f"0{of(dig, 2)} {of(dig, 4)} {of(dig, 4)}", of(dig, 10)])
    person = lambda: r.choice([f"{of(dig, 3)}-{of(dig, 2)}-{of(dig, 4)}", of(dig, r.randint(8, 12)), f"{of(dig, 4)} {of(dig, 4)} {of(dig, 4)}"])
    date = lambda: f"{r.choice(('19', '20'))}{of(dig, 2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    plain = lambda: r.choice([date(), f"{date()} {r.randint(10, 23)}", of(dig, r.randint(7, 16)), f"978-{of(dig, 1)}-{of(dig, 2)}-{of(dig, 6)}-{of(dig, 1)}", f"{r.randint(1900, 2020)}-{r.randint(1900, 2020)}", f"{of(dig, 1)}.{of(dig, 9)}", f"{of(dig, 3)}.{of(dig, 3)}.{of(dig, 3)}"])
    name = lambda: r.choice([word(), f"{word()}.{word()}", f"{word()}{r.randint(1, 99)}"])
    at, dot = (lambda: r.choice([" (at) ", "(at)", " [at] ", "[at]", " at "])), (lambda: r.choice([" (dot) ", "(dot)", "[dot]", " dot ", "."]))
    top = lambda: r.choice(["com", "org", "net", "de", "edu"])

    def mail():
        a, d = at(), dot()
        if a == " at " and d == ".":
            d = " dot "
        return f"{name()}{a}{word()}{d}{top()}"

    kinds = [
        (3, 1, SECRET_CONTEXTS, key),
        (2, 0, RECORD_CONTEXTS, lambda: r.choice([of(hexa, r.choice((32, 40, 64))), f"{of(hexa, 8)}-{of(hexa, 4)}-{of(hexa, 4)}-{of(hexa, 12)}"])),
        (1, 0, None, lambda: of(hexa, r.choice((32, 40, 64)))),
        (2, 0, None, lambda: r.choice([long_word(), long_word().capitalize(), "-" * r.randint(20, 40), "_" * r.randint(20, 40), "-".join(word() for _ in range(12)), "_".join(word() for _ in range(12))])),
        (1, 0, SECRET_CONTEXTS, lambda: r.choice([long_word(), "-" * 30, "-".join(word() for _ in range(12))])),
        (3, 1, PHONE_CONTEXTS, phone),
        (2, 1, PERSON_CONTEXTS, person),
        (3, 0, None, plain),
        (2, 0, NUMBER_CONTEXTS, lambda: r.choice([plain(), phone(), person()])),
        (2, 1, MAIL_CONTEXTS, mail),
        (1, 1, None, lambda: f"{name()}{r.choice(['(at)', ' [at] ', '[at]'])}{word()}{r.choice(['(dot)', ' [dot] '])}{top()}"),
        (3, 0, None, lambda: f"{word()} at {word()}.{word().capitalize()}"),
    ]
    weighed = [k for k in kinds for _ in range(k[0])]
    out = []
    for i in range(n):
        _, label, contexts, value = r.choice(weighed)
        part = ("fit", "fit", "fit", "tune", "held")[i % 5]
        context = r.choice(contexts[part == "held"]) if contexts else ""
        before = " ".join(word() for _ in range(r.randint(0, 5)))
        out.append(((before + " " + context)[-40:], value(), label, part))
    return out


# ---------------------------------------------------------------- positions


def hinted(kind: str, text: Column, value: Column) -> Column:
    """value, or null where the text lacks what a match of the kind must hold."""
    if kind not in HINTS:
        return value
    test = F.contains(text, F.lit(HINTS[kind])) if len(HINTS[kind]) == 1 else text.rlike(HINTS[kind])
    return F.when(test, value)


def chunks(items: Column) -> Column:
    """The array in slices of CHUNK members; none if it is empty."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / CHUNK).cast("int") - 1, F.lit(0))), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))
    return F.filter(parts, lambda p: F.size(p) > 0)


def running(parts: Column, first: Column, value, each) -> Column:
    """each(part, value before it) of each part, where the value behind a part is value(the one before, part)."""
    ends = F.aggregate(parts, F.array(first), lambda acc, p: F.concat(acc, F.array(value(F.element_at(acc, -1), p))))
    return F.zip_with(parts, F.slice(ends, 1, F.size(parts)), each)


FOUND = "struct<start:int,before:string,value:string>"


def places(part: Column) -> Column:
    """Of a chunk of alternating pieces and matches: struct<at, odd, last, out>, its length in code points and its
    matches with starts from the chunk's own."""
    start = F.expr(f"cast(struct(0 as at, false as odd, '' as last, array() as out) as struct<at:int,odd:boolean,last:string,out:array<{FOUND}>>)")

    def step(acc, x):
        one = F.struct(acc["at"].alias("start"), F.substring(acc["last"], -40, 40).alias("before"), x.alias("value"))
        out = F.when(acc["odd"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.char_length(x)).alias("at"), (~acc["odd"]).alias("odd"), x.alias("last"), out.alias("out"))

    return F.aggregate(part, start, step)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    each = F.split(F.reverse(number), "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 1, (2 * c.try_cast("int")) % 10 + F.floor(c.try_cast("int") / 5).cast("int")).otherwise(c.try_cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(BYTE_PARTS)
    if kind == "card":
        n = digits(value)
        return F.length(n).between(16, 19) & luhn(n)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def features(kind: str, x: Column) -> Column:
    """The features of a candidate (a struct of before and value) as integers."""
    v, number = x["value"], digits(x["value"])
    letters = F.regexp_replace(v, "[^A-Za-z]", "")
    flag = lambda c: c.cast("int")
    values = {
        **{f"is_{k}": F.lit(int(k == kind)) for k in GENERATORS},
        "length": F.char_length(v), "digits": F.length(number), "letters": F.length(letters), "upper": F.length(F.regexp_replace(letters, "[a-z]", "")),
        "others": F.char_length(v) - F.length(number) - F.length(letters), "switches": F.regexp_count(v, F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]")),
        "hex_only": flag(v.rlike("^[0-9a-f]+$")), "dated": flag(v.rlike(r"^(?:19|20)[0-9]{2}(?:-[01][0-9]-[0-3][0-9](?: [0-9]{1,2})?|-(?:19|20)[0-9]{2})$")), "grouped": flag(v.rlike(r"^\(?[0-9]{3}\)?[ -][0-9]{2,3}[ -][0-9]{4}$")),
        "spelled": flag(v.rlike(r"[(\[](?:at|dot)[)\]]| dot ")),
        **{k: flag(x["before"].rlike(p)) for k, p in CUES.items()},
    }
    return F.struct(*[values[k].alias(k) for k in FEATURES])


# ---------------------------------------------------------------- boosting


class Boosted:
    """Trees of depth two: (feature, limit, (feature, limit, low, high), (feature, limit, low, high)), low where the
    feature is at most the limit; and thresholds by kind."""

    def __init__(self, bias: float, trees: list, thresholds: dict[str, float]) -> None:
        self.bias, self.trees, self.thresholds = bias, trees, thresholds

    def score(self, row: dict) -> float:
        pick = lambda node: node[3] if row[node[0]] > node[1] else node[2]
        return self.bias + sum(pick(pick(t)) for t in self.trees)

    def expression(self, x: Column) -> Column:
        node = lambda t, low, high: F.when(x[t[0]] <= t[1], low).otherwise(high)
        leaf = lambda t: node(t, F.lit(t[2]), F.lit(t[3]))
        return reduce(lambda a, t: a + node(t, leaf(t[2]), leaf(t[3])), self.trees, F.lit(self.bias))


def boost(rows: np.ndarray, labels: np.ndarray, rounds: int = 40, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
    """Gradient boosting of the logistic loss, by Newton steps over rows of integers, one column a feature; limits are
    up to 64 quantiles of a column. Deterministic."""
    limits = [np.unique(np.quantile(x, np.linspace(0, 1, 65), method="lower"))[:-1] for x in rows.T]
    bins = [np.searchsorted(c, x, side="left") for c, x in zip(limits, rows.T, strict=True)]  # limit i splits bins up to i
    base = math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    z = np.full(len(labels), base)

    def split(own, g, h):
        best = (-1.0, 0, -1)
        for f, c in enumerate(limits):
            if not len(c):
                continue
            a, b = (np.cumsum(np.bincount(bins[f][own], weights=w[own], minlength=len(c) + 1)) for w in (g, h))
            gain = np.round(a[:-1] ** 2 / (b[:-1] + ridge) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + ridge), 9)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), f, int(c[k])), key=lambda x: x[0])
        return best[1], best[2]

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - labels, p * (1 - p)
        leaf = lambda own: float(-rate * g[own].sum() / (h[own].sum() + ridge))  # noqa: E731, B023
        everything = np.ones(len(labels), dtype=bool)
        f, c = split(everything, g, h)
        sides = []
        for own in (rows[:, f] <= c, rows[:, f] > c):
            f2, c2 = split(own, g, h)
            low, high = own & (rows[:, f2] <= c2), own & (rows[:, f2] > c2)
            sides.append((FEATURES[f2], c2, leaf(low), leaf(high)))
            z = z + np.where(low, sides[-1][2], 0) + np.where(high, sides[-1][3], 0)
        trees.append((FEATURES[f], c, *sides))
    return Boosted(base, trees, dict.fromkeys(GENERATORS, 0.0))


def threshold(scores: list[float], labels: list[int]) -> float:
    """The middle of the gap with the fewest errors, the widest such gap."""
    own = sorted(zip(scores, labels, strict=True))
    if not 0 < sum(labels) < len(labels):
        return 0.0
    wrong = np.concatenate(([0], np.cumsum([y for _, y in own]))) + np.concatenate((np.cumsum([1 - y for _, y in own][::-1])[::-1], [0]))
    values = [own[0][0] - 1, *(x for x, _ in own), own[-1][0] + 1]
    gaps = [(-int(w), values[k + 1] - values[k], (values[k] + values[k + 1]) / 2) for k, w in enumerate(wrong)]
    return max(gaps)[2]


def judged(spark: SparkSession, examples: list[tuple[str, str, int, str]]) -> list[tuple[str, dict, int, str]]:
    """(kind, features, label, part) of each generator that takes an example's value whole."""
    frame = spark.createDataFrame(examples, "before string, value string, label int, part string")
    kinds = [F.when(F.col("value").rlike("^" + p + "$"), features(k, F.struct("before", "value"))).alias(k) for k, p in GENERATORS.items()]
    rows = frame.select("label", "part", *kinds).collect()  # as many rows as there are examples
    return [(k, r[k].asDict(), r["label"], r["part"]) for r in rows for k in GENERATORS if r[k] is not None]


_FITTED: list[Boosted] = []


def fitted(spark: SparkSession) -> Boosted:
    """The model, fitted once a session to the generated set, with thresholds from its part for them."""
    if not _FITTED:
        found = judged(spark, [e for e in generated() if e[3] != "held"])
        fit = [(f, y) for _, f, y, part in found if part == "fit"]
        model = boost(np.array([[f[x] for x in FEATURES] for f, _ in fit]), np.array([y for _, y in fit], dtype=float))
        for kind in GENERATORS:
            own = [(model.score(f), y) for k, f, y, part in found if k == kind and part == "tune"]
            model.thresholds[kind] = threshold([x for x, _ in own], [y for _, y in own])
        _FITTED.append(model)
    return _FITTED[0]


# ---------------------------------------------------------------- spans


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, then base and extra: array<struct<kind, start, end, value>>, sorted by kind as listed and
    start, code points, end exclusive. base has the valid matches of the base kinds; extra the candidates that the
    trees select and that no base span covers. A row for each row of docs.

    Null and empty texts have no spans. Other columns are not read.
    """
    model = fitted(docs.sparkSession)
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    kept, keep = keep, ("row",)
    out = pack(docs, kept, F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text).alias("__text"))
    patterns = {**BASE, **GENERATORS}
    # A layer for each step, so that none is evaluated twice.
    out = out.select(*keep, *[hinted(k, F.col("__text"), F.regexp_replace("__text", p, f"{MARK}$0{MARK}")).alias(f"__{k}") for k, p in patterns.items()])
    out = out.select(*keep, *[F.when(F.contains(f"__{k}", F.lit(MARK)), F.split(f"__{k}", MARK, -1)).alias(f"__{k}") for k in patterns])
    out = out.select(*keep, *[F.transform(chunks(F.col(f"__{k}")), places).alias(f"__{k}") for k in patterns])

    def moved(kind: str) -> Column:
        """Matches with starts from the text's own; null without any."""
        each = lambda p, at: F.transform(p["out"], lambda x: F.struct((x["start"] + at).alias("start"), x["before"].alias("before"), x["value"].alias("value")))
        return F.flatten(running(F.col(f"__{kind}"), F.lit(0), lambda at, p: at + p["at"], each))

    out = out.select(*keep, *[moved(k).alias(f"__{k}") for k in patterns])
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)")

    def spans(kind: str, own: Column) -> Column:
        made = F.transform(own, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.char_length(x["value"])).alias("end"), x["value"].alias("value")))
        return F.coalesce(made, none)

    def selected(kind: str) -> Column:
        seen = F.transform(F.col(f"__{kind}"), lambda x: F.struct(x["start"].alias("start"), x["value"].alias("value"), features(kind, x).alias("f")))
        return F.filter(seen, lambda x: model.expression(x["f"]) > model.thresholds[kind])

    def passing(kind: str) -> Column:
        return F.filter(F.col(f"__{kind}"), lambda x: valid(kind, x["value"]))

    base = F.concat(*[spans(k, passing(k)) for k in BASE])
    extra = F.concat(*[spans(k, selected(k)) for k in GENERATORS])
    return unpack(uncovered(out.select(*keep, base.alias("base"), extra.alias("__extra")), keep), kept, "base", "extra")


def uncovered(found: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """found with extra: the spans of __extra that lie within none of base, by kind and start. In the order of starts,
    base first, a span is covered if the largest end before it reaches its own."""
    order = F.array(*map(F.lit, GENERATORS))
    marks = lambda c, extra: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(extra).alias("extra"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
    both = F.when((F.size("base") > 0) & (F.size("__extra") > 0), F.array_sort(F.concat(marks(F.col("base"), 0), marks(F.col("__extra"), 1))))
    out = found.withColumn("__both", both)
    out = out.withColumn("__parts", chunks(F.col("__both")))
    top = lambda p: F.coalesce(F.array_max(F.transform(F.filter(p, lambda x: x["extra"] == 0), lambda x: x["end"])), F.lit(-1))
    kind = "array<struct<by:int,start:int,kind:string,end:int,value:string>>"

    def free(part, before):
        start = F.struct(before.alias("top"), F.array().cast(kind).alias("out"))

        def step(acc, x):
            one = F.struct(F.array_position(order, x["kind"]).cast("int").alias("by"), x["start"], x["kind"], x["end"], x["value"])
            more = F.when((x["extra"] == 1) & (acc["top"] < x["end"]), F.concat(acc["out"], F.array(one).cast(kind))).otherwise(acc["out"])
            return F.struct(F.when(x["extra"] == 0, F.greatest(acc["top"], x["end"])).otherwise(acc["top"]).alias("top"), more.alias("out"))

        return F.aggregate(part, start, step)["out"]

    kept = F.array_sort(F.flatten(running(F.col("__parts"), F.lit(-1), lambda before, p: F.greatest(before, top(p)), free)))
    told = F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return out.select(*keep, "base", F.when(F.col("__both").isNotNull(), told).otherwise(F.col("__extra")).alias("extra"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every span replaced by its kind in brackets, from the last to the first; of spans that overlap,
    an earlier one ends where the later one begins. Rows without spans and null texts stay as they are. Ids must be
    unique in found."""
    spans = F.transform(F.concat("base", "extra"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    both = docs.select(id_col, text_col).join(found.select(id_col, F.reverse(F.array_sort(spans)).alias("__s")), id_col, "left")

    def cut(acc, s):
        end = F.least(s["end"], acc["at"])
        text = F.overlay(acc["text"], F.concat(F.lit("["), s["kind"], F.lit("]")), s["start"] + 1, end - s["start"])
        return F.struct(F.when(s["start"] < acc["at"], text).otherwise(acc["text"]).alias("text"), s["start"].alias("at"))

    done = F.aggregate("__s", F.struct(F.col(text_col).alias("text"), F.lit(1 << 30).alias("at")), cut)["text"]
    return both.select(id_col, F.coalesce(done, F.col(text_col)).alias(text_col))


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    spans = F.concat("base", "extra")
    return found.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))
