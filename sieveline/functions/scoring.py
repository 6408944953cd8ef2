"""Message scoring: pattern families, weights, heuristic score and the blend with a model's score."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import count
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import Patterns
from .fusion import band_text, risk_level
from .text import AFTER_WORD, BEFORE_WORD, BOUNDARY, SCRIPT_SPACES, has_homoglyphs, normalized, strip


def _as_script(regex: str) -> str:
    """White space (of normalised text) and the dot as JavaScript has them."""
    return re.sub(r"(?<!\\)[.]", "[^\\n\\r\u2028\u2029]", regex.replace(r"[^\s]", "[^\\t-\\r\x20\xa0\ufeff]"))


@dataclass(frozen=True)
class Rule:
    """One expression. A global rule counts its matches; another counts one, and one for each of its groups.

    Every match holds one of `needs`, so texts without any are settled by plain search, which costs far less.
    """

    regex: str
    groups: int = 0
    every: bool = False
    needs: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        """For normalised text, which is in lower case. Where all alternatives start (end) with a letter or digit, a boundary there asks one side alone."""
        out = self.regex
        if out.startswith(r"\b(") and not re.search(r"[(|]\\\$", out):
            out = BEFORE_WORD + out[2:]
        if out.endswith(r")\b") and not re.search(r"%[|)]", out):
            out = out[:-2] + AFTER_WORD
        return _as_script(out.replace(r"\b", BOUNDARY))

    @property
    def re2(self) -> str:
        """For Arrow, whose boundaries and digits are ASCII as JavaScript's are: the whole match is group m, the others are g1, g2, ..."""
        number = count(1)
        return f"(?P<m>{_as_script(re.sub(r'(?<!\\)[(](?![?])', lambda _: f'(?P<g{next(number)}>', self.regex))})"

    @property
    def one_group(self) -> bool:
        """Whether the only group is the whole expression between its boundaries."""
        return self.groups == 1 and self.regex.startswith(r"\b(") and self.regex.endswith(r")\b")


# Families in order, their expressions (as JavaScript has them, case-insensitive) and weights.
FAMILIES: dict[str, tuple[float, tuple[Rule, ...]]] = {
    "urgency": (
        0.3,
        (
            Rule(r"\b(urgent|immediately|asap|right now|within \d+ (hour|minute)|act fast|limited time|expires? (today|soon|in \d+))\b", 3, False, ("urgent", "immediately", "asap", "right now", "within ", "act fast", "limited time", "expire")),
            Rule(r"\b(hurry|don't wait|last chance|final notice|immediate action)\b", 1, False, ("hurry", "don't wait", "last chance", "final notice", "immediate action")),
            Rule(r"!{2,}", 0, True, ("!!",)),
        ),
    ),
    "financial_request": (
        0.4,
        (
            Rule(r"\b(wire transfer|send money|bank account|routing number|payment|bitcoin|crypto|gift card)\b", 1, False, ("wire transfer", "send money", "bank account", "routing number", "payment", "bitcoin", "crypto", "gift card")),
            Rule(r"\b(fees?|tax|pay|amount|\$\d+|\d+ dollars?|funds?)\b", 1, False, ("fee", "tax", "pay", "amount", "$", " dollar", "fund")),
            Rule(r"\b(western union|moneygram|zelle|venmo|cash app|paypal)\b", 1, False, ("western union", "moneygram", "zelle", "venmo", "cash app", "paypal")),
        ),
    ),
    "coercion": (
        0.35,
        (
            Rule(r"\b(arrested|jail|police|lawsuit|legal action|court|warrant)\b", 1, False, ("arrested", "jail", "police", "lawsuit", "legal action", "court", "warrant")),
            Rule(r"\b(suspended|terminated|deleted|disabled|blocked|banned)\b", 1, False, ("suspended", "terminated", "deleted", "disabled", "blocked", "banned")),
            Rule(r"\b(failure to|unless you|or else|consequences)\b", 1, False, ("failure to", "unless you", "or else", "consequences")),
        ),
    ),
    "impersonation": (
        0.35,
        (
            Rule(r"\b(irs|social security|medicare|fbi|doj|department of|government|official)\b", 1, False, ("irs", "social security", "medicare", "fbi", "doj", "department of", "government", "official")),
            Rule(r"\b(apple|google|microsoft|amazon|facebook|meta|netflix|paypal|bank of|wells fargo|chase)\b", 1, False, ("apple", "google", "microsoft", "amazon", "facebook", "meta", "netflix", "paypal", "bank of", "wells fargo", "chase")),
            Rule(r"\b(customer service|support team|security team|fraud department)\b", 1, False, ("customer service", "support team", "security team", "fraud department")),
        ),
    ),
    "suspicious_link": (
        0.25,
        (
            Rule(r"https?:\/\/[^\s]+", 0, True, ("http",)),
            Rule(r"\b(click here|click below|click this link|tap to|verify at)\b", 1, False, ("click here", "click below", "click this link", "tap to", "verify at")),
            Rule(r"bit\.ly|tinyurl|goo\.gl|t\.co|shorturl", 0, False, ("bit.ly", "tinyurl", "goo.gl", "t.co", "shorturl")),
        ),
    ),
    "personal_info_request": (
        0.4,
        (
            Rule(r"\b(ssn|social security number|date of birth|dob|mother'?s? maiden|password|pin|cvv)\b", 1, False, ("ssn", "social security number", "date of birth", "dob", " maiden", "password", "pin", "cvv")),
            Rule(r"\b(verify your|confirm your|update your) (identity|account|information|details)\b", 2, False, ("verify your", "confirm your", "update your")),
            Rule(r"\b(credit card|debit card|account number|login credential)\b", 1, False, ("credit card", "debit card", "account number", "login credential")),
        ),
    ),
    "too_good_to_be_true": (
        0.35,
        (
            Rule(r"\b(congratulations|you('ve)? won|winner|selected|lucky)\b", 2, False, ("congratulations", " won", "winner", "selected", "lucky")),
            Rule(r"\b(prize|reward|lottery|jackpot|inheritance|million|billion)\b", 1, False, ("prize", "reward", "lottery", "jackpot", "inheritance", "million", "billion")),
            Rule(r"\b(free|no cost|guaranteed|100%|risk.?free)\b", 1, False, ("free", "no cost", "guaranteed", "100%")),
        ),
    ),
}
# What a homoglyph counts and says, and what is said of a blank text.
HOMOGLYPH = ("homoglyph_attack", 0.5, 0.9, "Suspicious Unicode characters detected")
WEIGHTS = {k: w for k, (w, _) in FAMILIES.items()} | {HOMOGLYPH[0]: HOMOGLYPH[1]}
NO_TEXT = "No text provided for analysis."
# Phrases that settle a message at once.
PHRASES = (
    "send money immediately",
    "wire transfer now",
    "you have won",
    "nigerian prince",
    "claim your prize",
    "irs warrant",
    "arrest warrant",
    "suspended your account",
    "verify immediately or",
    "bitcoin investment guaranteed",
)


def rule_match(text: Column, rule: Rule) -> Column:
    """What one rule finds in a normalised text, in one pass: all matches of a global rule, else the first or an empty string (no rule matches that)."""
    without = ~reduce(or_, (F.contains(text, F.lit(w)) for w in rule.needs)) if rule.needs else F.lit(False)
    if rule.every:
        return F.when(without, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)))
    return F.when(without, "").otherwise(F.regexp_extract(text, rule.java, 0))


def _named_rules() -> dict[str, Rule]:
    return {f"hit_{family}_{k}": rule for family, (_, rules) in FAMILIES.items() for k, rule in enumerate(rules)}


def _held(texts: pa.Array, rule: Rule) -> tuple[pa.Array, pa.Array]:
    """Which of a batch of texts a rule matches, and what it finds there: lists of all matches of a global rule, else structs of the first and its groups."""
    hit = pc.fill_null(pc.match_substring_regex(texts, rule.re2), False)
    held = texts.filter(hit)
    if rule.every:
        every = re.compile(rule.re2, re.ASCII)
        return hit, pa.array([every.findall(t) for t in held.to_pylist()], pa.list_(pa.string()))
    return hit, pc.extract_regex(held, rule.re2)


def _spread(hit: pa.Array, found: pa.Array, rest: pa.Array) -> pa.Array:
    return pc.replace_with_mask(rest, hit, found.cast(rest.type)) if len(found) else rest


def _find(texts: pa.Array, rule: Rule) -> pa.Array:
    """rule_match of a batch of texts."""
    hit, found = _held(texts, rule)
    if rule.every:
        sizes = _spread(hit, pc.list_value_length(found), pa.repeat(pa.scalar(0, pa.int32()), len(texts)))
        ends = np.cumsum([0, *sizes.to_numpy()], dtype="i4")
        return pa.ListArray.from_arrays(pa.array(ends), found.flatten(), mask=pc.is_null(texts))
    return _spread(hit, pc.struct_field(found, "m"), pc.if_else(pc.is_valid(texts), "", pa.scalar(None, pa.string())))


def _find_all(texts: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([_find(texts, rule) for rule in _named_rules().values()], list(_named_rules()))


def _count_all(texts: pa.Array) -> pa.Array:
    def one(rule: Rule) -> pa.Array:
        if rule.every:
            return pc.fill_null(pc.count_substring_regex(texts, rule.re2), 0).cast(pa.int32())
        return pc.if_else(pc.fill_null(pc.match_substring_regex(texts, rule.re2), False), pa.scalar(1 + rule.groups, pa.int32()), 0)

    return pa.StructArray.from_arrays([reduce(pc.add, map(one, rules)) for _, rules in FAMILIES.values()], list(FAMILIES))


def _say_all(texts: pa.Array) -> pa.Array:
    zero, empty = pa.repeat(pa.scalar(0, pa.int32()), len(texts)), pa.repeat(pa.scalar("", pa.string()), len(texts))
    out = {}
    for family, (_, rules) in FAMILIES.items():
        n, said = zero, []
        for rule in rules:
            hit, found = _held(texts, rule)
            if rule.every:
                own = pc.list_value_length(found)
                first = pa.array([", ".join(["", *x[:3]]) for x in found.to_pylist()], pa.string())
            else:
                own = pa.repeat(pa.scalar(1 + rule.groups, pa.int32()), len(found))
                first = pc.binary_join_element_wise("", *(pc.struct_field(found, g) for g in ["m", "g1", "g2"][: 1 + rule.groups]), ", ")
            n = pc.add(n, _spread(hit, own, zero))
            said.append(_spread(hit, first, empty))
        out |= {f"n_{family}": n, f"said_{family}": pc.utf8_slice_codeunits(pc.binary_join_element_wise(*said, ""), 2)}
    return pa.StructArray.from_arrays(list(out.values()), list(out))


def _with_heuristic(found: pa.StructArray, homoglyph: pa.Array) -> pa.Array:
    """Adds heuristic_from_counts, the same sums in the same order; of a null text as its SQL has it, where least passes over the missing quotient."""
    hits = [(pc.fill_null(homoglyph, False).to_numpy(zero_copy_only=False), HOMOGLYPH[2], HOMOGLYPH[1])]
    for family, (weight, _) in FAMILIES.items():
        n = found.field(f"n_{family}").to_numpy()
        hits.append((n > 0, np.minimum(0.95, 0.3 + n * 0.15), weight))
    top = sum(np.where(h, c * w, 0.0) for h, c, w in hits)
    under = sum(np.where(h, w, 0.0) for h, _, w in hits)
    n = sum(h.astype("i4") for h, _, _ in hits)
    with np.errstate(invalid="ignore"):
        score = np.fmin(1.0, top / under + np.minimum(0.3, n * 0.05))
    none = (n == 0) & homoglyph.is_valid().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([*found.flatten(), pa.array(np.where(none, 0.0, score))], [*(x.name for x in found.type), "heuristic"])


def _count_and_score(texts: pa.Array, homoglyph: pa.Array) -> pa.Array:
    return _with_heuristic(pa.StructArray.from_arrays(_count_all(texts).flatten(), [f"n_{family}" for family in FAMILIES]), homoglyph)


def _say_and_score(texts: pa.Array, homoglyph: pa.Array) -> pa.Array:
    return _with_heuristic(_say_all(texts), homoglyph)


def rule_matches(text: Column) -> dict[str, Column]:
    """rule_match of all rules, by names of their own: select them, so that counts and texts come from one pass.

    Arrow runs a rule over a batch of texts by an automaton, in time linear in their length; Java's expressions try each
    alternative at each place.
    """
    kinds = ", ".join(f"{name}: {'array<string>' if rule.every else 'string'}" for name, rule in _named_rules().items())
    found = F.arrow_udf(_find_all, f"struct<{kinds}>")(text)
    return {name: found[name] for name in _named_rules()}


def family_counts(text: Column) -> dict[str, Column]:
    """family_count of all families on a normalised text in one pass, where what matched isn't wanted: select them."""
    counts = F.arrow_udf(_count_all, f"struct<{', '.join(f'{family}: int' for family in FAMILIES)}>")(text)
    return {family: counts[family] for family in FAMILIES}


def family_matches(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """family_count and matched_text of all families on a normalised text in one pass: select them."""
    found = F.arrow_udf(_say_all, f"struct<{', '.join(f'n_{family}: int, said_{family}: string' for family in FAMILIES)}>")(text)
    return {family: found[f"n_{family}"] for family in FAMILIES}, {family: found[f"said_{family}"] for family in FAMILIES}


def family_scores(text: Column, homoglyph: Column, said: bool = False) -> dict[str, Column]:
    """heuristic, n_<family> and, if asked for, said_<family> of a normalised text in one pass: select them.

    The score comes with the counts, as its sums over families would fill the method that Spark generates for what
    follows: the JVM never compiles one of more than 8,000 bytes.
    """
    kinds = {f"{x}_{family}": kind for family in FAMILIES for x, kind in (("n", "int"), ("said", "string")) if said or x == "n"} | {"heuristic": "double"}
    found = F.arrow_udf(_say_and_score if said else _count_and_score, f"struct<{', '.join(f'{name}: {kind}' for name, kind in kinds.items())}>")(text, homoglyph)
    return {name: found[name] for name in kinds}


def _found(family: str, text: Column | None, hits: dict[str, Column] | None) -> list[tuple[Rule, Column]]:
    return [(rule, rule_match(text, rule) if hits is None else hits[f"hit_{family}_{k}"]) for k, rule in enumerate(FAMILIES[family][1])]


def family_count(text: Column | None, family: str, hits: dict[str, Column] | None = None) -> Column:
    """The family's count on a normalised text, or on what its rules found."""
    first, *rest = (F.size(hit) if rule.every else F.when(hit != "", 1 + rule.groups).otherwise(0) for rule, hit in _found(family, text, hits))
    return sum(rest, first)


def matched_text(text: Column | None, family: str, hits: dict[str, Column] | None = None) -> Column:
    """The first three entries of each rule's match (whole, then groups; an unmatched group is empty), comma-joined.

    Groups are taken from the match alone, which the rule matches in the same way: it ends at a boundary on both sides.
    """
    parts = []
    for rule, hit in _found(family, text, hits):
        if rule.every:
            parts.append(F.slice(hit, 1, 3))
            continue
        groups = [hit] if rule.one_group else [F.regexp_extract(hit, rule.java, g) for g in range(1, min(3, 1 + rule.groups))]
        parts.append(F.when(hit != "", F.array(hit, *groups)).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.concat(*parts), ", ")


def confidence(count: Column) -> Column:
    return F.least(F.lit(0.95), F.lit(0.3) + count * F.lit(0.15))


def detected(counts: dict[str, Column], homoglyph: Column) -> dict[str, Column]:
    """Whether detect_patterns has a type, by type, straight from family counts."""
    return {HOMOGLYPH[0]: homoglyph} | {family: n > 0 for family, n in counts.items()}


def detect_types(counts: dict[str, Column], homoglyph: Column) -> Column:
    """The types of detect_patterns straight from family counts, where matched texts aren't wanted."""
    return F.array_compact(F.array(*(F.when(hit, kind) for kind, hit in detected(counts, homoglyph).items())))


def detect_patterns(raw: Column, text: Column | None = None, hits: dict[str, Column] | None = None) -> Column:
    """array<struct<type, confidence, matchedText>>: homoglyphs first, then the families that match, in order.

    text is the normalised text, hits what rule_matches gave for it; pass columns, so that they are worked out once.
    """
    text = normalized(raw) if text is None else text
    if hits is None:
        return patterns_of(has_homoglyphs(raw), *family_matches(text))
    counts = {family: family_count(text, family, hits) for family in FAMILIES}
    return patterns_of(has_homoglyphs(raw), counts, {family: matched_text(text, family, hits) for family in FAMILIES})


def patterns_of(homoglyph: Column, counts: dict[str, Column], said: dict[str, Column]) -> Column:
    """detect_patterns straight from family counts and matched texts."""
    kind = "struct<type:string,confidence:double,matchedText:string>"
    pattern = lambda name, sure, text: F.struct(name.alias("type"), sure.alias("confidence"), text.alias("matchedText")).cast(kind)
    found = [F.when(homoglyph, pattern(F.lit(HOMOGLYPH[0]), F.lit(HOMOGLYPH[2]), F.lit(HOMOGLYPH[3])))]
    return F.array_compact(F.array(*found, *(F.when(n > 0, pattern(F.lit(family), confidence(n), said[family])) for family, n in counts.items())))


def heuristic_score(patterns: Column) -> Column:
    """Weighted mean confidence plus 0.05 a pattern (0.3 at most), 1 at most; 0 without patterns."""
    weights = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    weight = lambda p: F.coalesce(F.nullif(weights[p["type"]], F.lit(0.0)), F.lit(0.2))
    top = F.aggregate(patterns, F.lit(0.0), lambda a, p: a + p["confidence"] * weight(p))
    under = F.aggregate(patterns, F.lit(0.0), lambda a, p: a + weight(p))
    return F.when(F.size(patterns) == 0, 0.0).otherwise(F.least(F.lit(1.0), top / under + F.least(F.lit(0.3), F.size(patterns) * 0.05)))


def heuristic_from_counts(counts: dict[str, Column], homoglyph: Column | None = None) -> Column:
    """heuristic_score straight from family counts, without arrays: the fast path where matched texts aren't wanted."""
    hits = [(c > 0, confidence(c), FAMILIES[k][0]) for k, c in counts.items()]
    if homoglyph is not None:
        hits.insert(0, (homoglyph, F.lit(HOMOGLYPH[2]), HOMOGLYPH[1]))
    add = lambda xs: sum(xs[1:], xs[0])
    top = add([F.when(h, c * F.lit(w)).otherwise(0.0) for h, c, w in hits])
    under = add([F.when(h, F.lit(w)).otherwise(0.0) for h, _, w in hits])
    n = add([h.cast("int") for h, _, _ in hits])
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), top / under + F.least(F.lit(0.3), n * F.lit(0.05))))


def quick_check(raw: Column) -> Column:
    """Whether any of PHRASES is in the lower-case text, which is read once, up to the first."""
    return Patterns(PHRASES).any(F.lower(raw))


def text_score(model: Column, heuristic: Column) -> Column:
    """0.6 of the model's score and 0.4 of the heuristic; a model score of -1 is an error and gives null."""
    return F.when(model != -1, F.lit(0.6) * model + F.lit(0.4) * heuristic)


def text_analysis(raw: Column, score: Column) -> Column:
    """struct<is_scam, confidence, risk_level, text_score, fused_score, explanation>: a blank text has a fixed result, whatever its score."""
    blank = is_blank(raw)
    pick = lambda fixed, other, name: F.when(blank, fixed).otherwise(other).alias(name)
    return F.struct(
        pick(F.lit(False), score > 0.5, "is_scam"),
        pick(F.lit(0.0), F.when(score > 0.5, 0.75).otherwise(0.5), "confidence"),
        pick(F.lit("low"), risk_level(score), "risk_level"),
        pick(F.lit(0.0), score, "text_score"),
        pick(F.lit(0.0), score, "fused_score"),
        pick(F.lit(NO_TEXT), band_text(score), "explanation"),
    )


def is_blank(raw: Column) -> Column:
    return F.coalesce(strip(raw, SCRIPT_SPACES), F.lit("")) == ""
