"""Personal data: generators propose spans, boosted trees choose among them.

Base spans are exact: one pattern a kind, leftmost and non-overlapping, and a
check of each match (parts, digits, Luhn); failing matches are dropped.  They
always stay.

Beside them generators with a high recall propose spans of looser forms: mail
addresses with spelled-out signs, four numbers with other separators, digit
groups with brackets, dots or slashes.  Proposals may overlap one another and
the base spans.  Boosted trees score a proposal by its format (digits,
separators, lengths, parts, Luhn) and context (the words and marks around it).
They learn from the corpus itself, as positive and unlabelled examples.
Examples are the proposals on a base span of their kind, and each base span
once more rewritten into a looser form in its place.  Counter-examples are
proposals with evidence against their kind (``contradicted``), those on a base
span of another kind, and those open ones that are not like the examples.  The
last are found with spies: a fifth of the rewritten spans is hidden among the open
proposals, trees are fitted, and an open proposal that scores below half of what
nearly all spies of its kind reach (all but the share ``NOISE``) is a
counter-example; a second fit then learns from these.  Open proposals like the examples have no label.

Scores are calibrated by isotonic regression on the proposals that the trees
did not see, and a kind's threshold is the lowest score whose calibrated
precision, and the lower confidence bound of the precision from there on, reach
``precision``; without one the kind gets no spans beside its base spans.
Accepted proposals that overlap a base span or a better proposal give way, and
one with evidence against it is never added.

Trees are fitted on at most ``max_rows`` proposals, half of them examples, those
with the smallest hash of document and place among seven tenths of all.
Thresholds come from all of the other three tenths, counted per kind and score
in steps of 1 / ``STEPS``, so the table that reaches the driver is bounded.
Every document is searched whole.

Defined results: a null or empty text has no spans; places are code points, the
end exclusive; repeated rows are searched each; an empty table gives no rows;
columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simcheck.llm.boosting import BoostedTrees, fit_boosted, isotonic
from simcheck.session import materialize

KINDS = ("email", "ip", "card", "phone")
MAX_ROWS = 20_000
ROUNDS, DEPTH, SEED = 10, 3, 11
PRECISION, SUPPORT = 0.95, 1
#: Open proposals below half of the score that all spies but this share reach are counter-examples; normal quantile.
NOISE, CONFIDENCE = 0.01, 1.645
STEPS = 1000
ROWS_OUT = 2048

# Fixed patterns of the base spans, in a form that is linear in the text: a run
# of digits is taken whole, and a mail address is found from its @ sign.
BASE = {
    "email": re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
MAIL_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
LOOSE = {
    "email": re.compile(
        r"(?i)[a-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\{at\}|\sat\s)\s?[a-z0-9-]{1,63}"
        r"(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[a-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"[0-9]{1,4}(?:(?:\.|\[\.\]|\(\.\)| \. |-)[0-9]{1,4}){3}"),
    "card": re.compile(r"[0-9](?:[\x20._/-]{0,2}[0-9]){12,21}"),
    "phone": re.compile(r"(?:\+|00)?\(?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,16}"),
}
_MAYBE_MAIL = re.compile(r"(?i)@|[(\[{\s]at[)\]}\s].{0,80}[(\[{\s.]")
_DIGITS = re.compile(r"[0-9]")
_CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "address", "courriel", "correo"),
    "ip": ("ip", "host", "server", "from", "addr", "ping"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "number"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def accepted(kind: str, match: str) -> bool:
    """The check of a base match."""
    if kind == "email":
        return True
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in match.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = "".join(c for c in match if "0" <= c <= "9")
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans (kind, start, end), by kind and start."""
    out: list[tuple[int, int, int]] = []
    has_digit = _DIGITS.search(text) is not None
    for k, kind in enumerate(KINDS):
        if (kind == "email" and "@" not in text or kind == "phone" and "+" not in text
                or kind != "email" and not has_digit):
            continue
        if kind == "email":
            out += mail_spans(text, k)
        else:
            out += [(k, *m.span()) for m in BASE[kind].finditer(text) if accepted(kind, m.group())]
    return out


def mail_spans(text: str, kind: int) -> list[tuple[int, int, int]]:
    """Addresses, each found from its @: the name is the run of name characters before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(MAIL_NAME))
        m = BASE["email"].match(text, at) if start < at else None
        if m:
            out.append((kind, start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


class Taken:
    """Disjoint places; tells whether another one meets them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "length", "digits", "letters", "spaces", "dots", "dashes",
            "brackets", "slashes", "groups", "longest_group", "shortest_group", "largest_part", "luhn", "plus",
            "leading_zero", "last_part", "before_space", "after_space", "before_mark", "after_mark", "before_digit",
            "after_digit", "before_word", "cue", "line_share")


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s) if KINDS[kind] != "email" else []      # digits say nothing about an address
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    before, after = text[start - 1:start], text[end:end + 1]
    words = text[max(0, start - 48):start].lower().split()
    words = words[-3:]
    line_start = text.rfind("\n", max(0, start - 200), start) + 1 or max(0, start - 200)
    line_end = text.find("\n", end, end + 200)
    line = (line_end if line_end >= 0 else min(len(text), end + 200)) - line_start
    cues = _CUES[KINDS[kind]]
    return [*(float(kind == k) for k in range(4)), float(min(len(s), 200)), float(min(len(digits), 40)),
            float(min(sum(c.isalpha() for c in s), 100)), float(sum(c.isspace() for c in s)), float(s.count(".")),
            float(s.count("-")), float(sum(c in "()[]{}" for c in s)), float(s.count("/")), float(len(groups)),
            float(min(max(sizes), 30)), float(min(sizes)), float(min(max((int(g[:9]) for g in groups), default=0), 10**6)),
            float(bool(digits) and luhn(digits)), float(s[:1] == "+"), float(digits[:1] == "0"),
            float(len(re.split(r"[.\s]", s)[-1])), float(not before or before.isspace()),
            float(not after or after.isspace()), float(before in ".,;:!?\"'()[]"), float(after in ".,;:!?\"'()[]"),
            float(before.isdigit()), float(after.isdigit()), float(len(words[-1]) if words else 0),
            float(any(c in w for w in words for c in cues)), len(s) / max(1, line)]


def proposals(text: str, good: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[float]]]:
    """Loose spans (kind, start, end, label, features).

    Label 1: on a base span of the kind; 2: such a span rewritten (at the base
    span's place, so it is never added); 0: against the evidence; -1: open.
    """
    out = []
    has_digit = bool(good) or _DIGITS.search(text) is not None
    for k, kind in enumerate(KINDS):
        if not (_MAYBE_MAIL.search(text) if kind == "email" else has_digit):
            continue
        base = Taken([(s, e) for g, s, e in good if g == k])
        others = Taken([(s, e) for g, s, e in good if g != k])
        for s, e in (m.span() for m in LOOSE[kind].finditer(text)):
            label = 1 if base.meets(s, e) else 0 if others.meets(s, e) or contradicted(text, k, s, e) else -1
            out.append((k, s, e, label, features(text, k, s, e)))
        for s, e in ((s, e) for g, s, e in good if g == k):
            before, form, after = text[max(0, s - 256):s], looser(k, text[s:e]), text[e:e + 256]
            out.append((k, s, e, 2, features(before + form + after, k, len(before), len(before) + len(form))))
    return out


_SEPARATOR = re.compile(r"[\x20().\-/]+")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}(?:[-/. ][0-9]+)*|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")
_THOUSANDS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{3}){2,}")
_DOT_SPELLED = re.compile(r"(?i)[(\[{\s]dot[)\]}\s]")


def contradicted(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a proposal has evidence against being of its kind."""
    s, name = text[start:end], KINDS[kind]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    if name == "email":
        last = re.split(r"[^A-Za-z0-9-]", s)[-1]
        sure = "@" in s or re.search(r"(?i)[(\[{]at[)\]}]", s) or _DOT_SPELLED.search(s)
        return not sure or not last.isalpha() or len(last) < 2
    if text[start - 1:start].isdigit() or text[end:end + 1].isdigit():
        return True
    if name == "ip":
        return "-" in s or any(int(g) > 255 for g in groups)
    if name == "card":
        return not (16 <= len(digits) <= 19 and luhn(digits))
    bare = len(groups) == 1 and s[:1] != "+"
    four = s.count(".") == 3 and len(groups) == 4 and s.replace(".", "").isdigit()
    return (bare or four or not 8 <= len(digits) <= 15 or max(map(len, groups)) < 2
            or bool(_DATE.fullmatch(s) or _THOUSANDS.fullmatch(s)))


def looser(kind: int, s: str) -> str:
    """A base span rewritten into one of the forms that only the generators know."""
    name, draw = KINDS[kind], crc32(s.encode())
    if name == "email":
        at, dot = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."))[draw % 4]
        user, host = s.rsplit("@", 1)
        return user + at + host.replace(".", dot)
    if name == "ip":
        return s.replace(".", ("[.]", "(.)", " . ")[draw % 3])
    groups = [g for g in _SEPARATOR.split(s.lstrip("+")) if g]
    digits = "".join(groups)
    fours = [digits[k:k + 4] for k in range(0, len(digits), 4)]
    if name == "card":
        return (".", "/", "_", "  ")[draw % 4].join(fours)
    if len(groups) < 2:
        return " ".join(fours)
    if len(digits) - len(groups[0]) >= 8 and len(groups) > 2 and draw % 4:      # without the country
        groups = groups[1:]
        if draw % 4 == 1:
            return f"({groups[0]}) " + "-".join(groups[1:])
    return (".", "-", " ", "/")[draw // 4 % 4].join(groups)


SPAN = "struct<kind: int, start: int, end: int>"
PROPOSAL = "struct<kind: int, start: int, end: int, label: int, x: array<double>>"


def search(docs: DataFrame) -> DataFrame:
    """(doc_id, base, proposed) of every row; ids pass as text, which pandas holds exactly beside nulls."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("kind", "start", "end", "label", "x")
        for pdf in batches:
            for k in range(0, len(pdf), ROWS_OUT):
                part = pdf.iloc[k:k + ROWS_OUT]
                base, proposed = [], []
                for text in part["text"]:
                    text = text or ""
                    good = base_spans(text)
                    base.append([dict(zip(names, s)) for s in good])
                    proposed.append([dict(zip(names, p)) for p in proposals(text, good)])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "base": base, "proposed": proposed})

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, f"doc_id string, base array<{SPAN}>, proposed array<{PROPOSAL}>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


@dataclass(frozen=True)
class PiiModel:
    trees: BoostedTrees | None
    bounds: dict[int, float]        # lowest accepted score of a kind


@dataclass(frozen=True)
class Spies:
    """Trees of the first fit, and the score of a kind below which an open proposal is a counter-example."""
    trees: BoostedTrees | None
    limits: dict[int, float]

    def against(self, kind: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(kind), bool)
        limit = np.array([self.limits.get(int(k), -1.0) for k in kind])
        return self.trees.probability(x) < limit


def lower_bound(examples: np.ndarray, n: np.ndarray, z: float = CONFIDENCE) -> np.ndarray:
    """Lower end of the score interval of a share."""
    share = examples / n
    middle, spread = share + z * z / (2 * n), z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n)


def fit(found: DataFrame, max_rows: int = MAX_ROWS, rounds: int = ROUNDS, depth: int = DEPTH, seed: int = SEED,
        precision: float = PRECISION, support: int = SUPPORT) -> PiiModel:
    """Trees from a bounded sample of the proposals, thresholds from all that the sample is not drawn from."""
    rows = (found.select("doc_id", F.explode("proposed").alias("p"))
            .select("doc_id", "p.kind", "p.start", F.col("p.label").cast("double").alias("label"), "p.x")
            .withColumn("draw", F.xxhash64("doc_id", "start", "kind")))
    tenth = F.pmod(F.col("draw"), F.lit(10))
    drawn = rows.filter(tenth < 7).orderBy("draw", "doc_id", "start", "kind", "label", "x")
    half = max_rows // 2
    sample = materialize(drawn.filter("label >= 1").limit(half).unionByName(drawn.filter("label < 1").limit(max_rows - half))
                         .coalesce(1)).toPandas()                       # max_rows at most
    sample = sample.sort_values(["draw", "doc_id", "start", "kind", "label"], kind="stable", ignore_index=True)
    label = sample["label"].to_numpy()
    example = label >= 1
    if example.all() or not example.any():
        return PiiModel(None, {})
    spark, x = found.sparkSession, np.array(sample["x"].tolist())

    def trees_on(keep: np.ndarray, ones: np.ndarray) -> BoostedTrees:
        part = pd.DataFrame({"label": ones[keep].astype(float), "x": sample["x"][keep]})
        frame = materialize(spark.createDataFrame(part, "label double, x array<double>").coalesce(1)
                            .select("label", array_to_vector("x").alias("x"))).coalesce(1)
        return fit_boosted(frame, rounds, depth, seed)

    spies = Spies(None, {})
    if (label < 0).any():
        spy = (label == 2) & (sample["draw"].to_numpy() // 10 % 5 == 0)
        first = trees_on(np.ones(len(label), bool), example & ~spy)
        score, kind = first.probability(x), sample["kind"].to_numpy()
        spies = Spies(first, {int(k): float(np.quantile(score[spy & (kind == k)], NOISE)) / 2 for k in np.unique(kind[spy])})
    keep = (label >= 0) | spies.against(sample["kind"].to_numpy(), x)
    if example[keep].all():
        return PiiModel(None, {})
    trees = trees_on(keep, example)
    counts = score_counts(rows.filter(tenth >= 7), trees, spies)
    bounds = {}
    for kind, part in counts.groupby("kind"):
        part = part.sort_values("step")
        low, share = isotonic(part["step"].to_numpy(), part["examples"].to_numpy(), part["n"].to_numpy())
        above = [part.loc[part["step"] >= s, ["examples", "n"]].sum() for s in low]
        examples, n = (np.array([a[c] for a in above]) for c in ("examples", "n"))
        if (ok := (share >= precision) & (lower_bound(examples, n) >= precision) & (examples >= support)).any():
            bounds[int(kind)] = float(low[np.argmax(ok)]) / STEPS
    return PiiModel(trees, bounds)


def score_counts(rows: DataFrame, trees: BoostedTrees, spies: Spies) -> pd.DataFrame:
    """(kind, step, examples, n) over all labelled rows and the open ones unlike the spies, scores rounded down.

    At most (STEPS + 1) rows a kind.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, label = np.array(pdf["x"].tolist()), pdf["label"].to_numpy()
                keep = (label >= 0) | spies.against(pdf["kind"].to_numpy(), x)
                step = np.floor(trees.probability(x) * STEPS).astype(np.int64)
                one = pd.DataFrame({"kind": pdf["kind"], "step": step, "examples": (label >= 1) * 1.0, "n": 1.0})[keep]
                yield one.groupby(["kind", "step"], as_index=False).sum()

    return (rows.select("kind", "label", "x").mapInPandas(run, "kind int, step long, examples double, n double")
            .groupBy("kind", "step").agg(F.sum("examples").alias("examples"), F.sum("n").alias("n")).toPandas())


def choose(found: DataFrame, model: PiiModel) -> DataFrame:
    """(doc_id, base, spans): base spans and the accepted proposals, by kind and start."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = []
            for base, proposed in zip(pdf["base"], pdf["proposed"], strict=True):
                all_spans = [(s["kind"], s["start"], s["end"]) for s in base]
                taken = Taken([(s, e) for _, s, e in all_spans])
                free = [p for p in proposed if p["label"] and p["kind"] in model.bounds and not taken.meets(p["start"], p["end"])]
                if free:
                    score = model.trees.probability(np.array([p["x"] for p in free]))
                    step = np.floor(score * STEPS) / STEPS
                    ranked = sorted(zip(-score, step, [(p["start"], p["end"], p["kind"]) for p in free], strict=True))
                    for _, low, (start, end, kind) in ranked:
                        if low >= model.bounds[kind] and not taken.meets(start, end):
                            taken.add(start, end)
                            all_spans.append((kind, start, end))
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in sorted(all_spans)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": pdf["base"], "spans": spans})

    done = found.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, f"doc_id string, base array<{SPAN}>, spans array<{SPAN}>")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, spans) of every row, spans ordered by kind and start."""
    found = materialize(search(docs))
    return choose(found, fit(found, **options))


def count_of(spans: str, kind: str) -> Column:
    """Number of spans of a kind; the function has one parameter, as Spark gives a second one the index."""
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """A text with its spans replaced by the names of their kinds."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        out += [text[at:max(at, start)], f"<{KINDS[kind]}>"] if end > at else []
        at = max(at, end)
    return "".join(out) + text[at:]
