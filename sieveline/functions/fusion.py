"""Fusion of visual and text scores: risk, bands, confidence, explanation, red flags and tips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band limits, the risk of each visual category, and what is said.
LOW, MEDIUM, HIGH, CRITICAL = 0.3, 0.5, 0.7, 0.85
VISUAL_RISK = {"safe": 0.0, "login": 0.4, "warning": 0.7, "critical": 0.95}
BANDS = (
    "This content appears to be safe based on our analysis.",
    "This content has some characteristics that warrant caution.",
    "This content shows several warning signs commonly associated with scams.",
    "This content displays multiple high-risk indicators of a potential scam.",
    "WARNING: This content has extremely high-risk characteristics of a scam. Exercise extreme caution.",
)
VISUAL_SAYS = {
    "login": "The image appears to contain login or authentication elements, which could indicate a phishing attempt.",
    "warning": "Visual elements in this image suggest urgency or warning, a common tactic in scams.",
    "critical": "The visual layout closely resembles known scam patterns.",
}
PATTERN_SAYS = {
    "urgency": "The text contains urgency language designed to pressure quick action.",
    "financial_request": "Financial transaction requests were detected, which is a red flag.",
    "coercion": "Threatening or coercive language was found, a hallmark of scam messages.",
    "impersonation": "The content may be impersonating a trusted organization or company.",
    "homoglyph_attack": "Suspicious Unicode characters detected that may be used to disguise malicious content.",
}
VISUAL_FLAGS = {"login": "Contains login/password fields", "warning": "Urgent visual warning elements", "critical": "Layout matches known scam patterns"}
PATTERN_FLAGS = {
    "urgency": ("Urgency language", True),
    "financial_request": ("Financial request", True),
    "coercion": ("Threatening language", True),
    "impersonation": ("Possible impersonation", True),
    "suspicious_link": ("Contains suspicious links", False),
    "personal_info_request": ("Requests personal info", True),
    "too_good_to_be_true": ("Too good to be true", True),
    "homoglyph_attack": ("Uses deceptive Unicode characters", False),
}
GENERAL_TIPS = ("Do not click any links in this message.", "Do not provide personal or financial information.", "Verify the sender through official channels.")
PATTERN_TIPS = {
    "financial_request": ("Never send money to someone you don't know personally.", "Legitimate organizations will never ask for payment via gift cards or wire transfer."),
    "urgency": ("Take your time - scammers create false urgency to prevent careful thinking.",),
    "impersonation": ("Contact the organization directly using their official website or phone number.",),
    "coercion": ("Government agencies do not threaten arrest via text or email.",),
    "too_good_to_be_true": ("If it sounds too good to be true, it probably is.",),
}
LAST_TIPS = ("Report this to the FTC at reportfraud.ftc.gov", "Block and delete this message.")


def visual_risk(probabilities: Column) -> Column:
    """Expected risk of a struct of category probabilities."""
    return F.lit(VISUAL_RISK["login"]) * probabilities["login"] + F.lit(VISUAL_RISK["warning"]) * probabilities["warning"] + F.lit(VISUAL_RISK["critical"]) * probabilities["critical"]


def visual_category(probabilities: Column) -> Column:
    """The category with the largest probability; of equal ones the first."""
    p = F.array(*(probabilities[k] for k in VISUAL_RISK))
    return F.element_at(F.array(*map(F.lit, VISUAL_RISK)), F.array_position(p, F.array_max(p)).cast("int"))


def risk_level(score: Column) -> Column:
    return F.when(score < LOW, "low").when(score < MEDIUM, "medium").when(score < HIGH, "high").otherwise("critical")


def fused_score(visual: Column, text: Column, mode: str = "max", weights: tuple[float, float] = (0.4, 0.6)) -> Column:
    """By the larger score, or by weights; a missing side counts as 0 for max and gives the other its weight otherwise."""
    v, t = F.coalesce(visual, F.lit(0.0)), F.coalesce(text, F.lit(0.0))
    if mode == "weighted":
        return F.when(visual.isNull(), t).when(text.isNull(), v).otherwise(v * weights[0] + t * weights[1])
    return F.greatest(v, t)


def fusion_confidence(visual: Column, visual_confidence: Column, text: Column) -> Column:
    """Larger when both sides agree; 0 without either."""
    own = F.when(text > 0.5, 0.8).otherwise(0.5)
    both = F.greatest(visual_confidence, own) * (F.lit(0.5) + F.lit(0.5) * (1 - F.abs(visual - text)))
    return (
        F.when(visual.isNotNull() & text.isNotNull(), both)
        .when(visual.isNotNull(), visual_confidence * 0.7)
        .when(text.isNotNull(), F.when(text > 0.5, 0.75).otherwise(0.5))
        .otherwise(0.0)
    )


def fuse(visual: Column, visual_confidence: Column, text: Column, mode: str = "max") -> Column:
    """struct<fused_score, is_scam, risk_level, confidence>. Confidence is that of max fusion in every mode; quick gives the first two."""
    score = fused_score(visual, text, mode)
    out = [score.alias("fused_score"), (score > MEDIUM).alias("is_scam")]
    if mode != "quick":
        out += [risk_level(score).alias("risk_level"), fusion_confidence(visual, visual_confidence, text).alias("confidence")]
    return F.struct(*out)


def _has(types: Column | dict[str, Column], kind: str) -> Column:
    """types: an array of them, or whether each is there, which spares the array."""
    there = types.get(kind, F.lit(False)) if isinstance(types, dict) else F.array_contains(types, kind)
    return F.coalesce(there, F.lit(False))


def band_text(score: Column) -> Column:
    return F.when(score < LOW, BANDS[0]).when(score < MEDIUM, BANDS[1]).when(score < HIGH, BANDS[2]).when(score < CRITICAL, BANDS[3]).otherwise(BANDS[4])


def explanation(score: Column, category: Column, visual_confidence: Column, types: Column | dict[str, Column]) -> Column:
    """A sentence for the band, one for what is seen, one for each family found, joined by spaces."""
    seen = [F.when((category == k) & (visual_confidence > 0.3), said) for k, said in VISUAL_SAYS.items()]
    return F.concat_ws(" ", band_text(score), *seen, *(F.when(_has(types, k), said) for k, said in PATTERN_SAYS.items()))


def red_flags(category: Column, visual_confidence: Column, patterns: Column, most: int = 5) -> Column:
    """What is seen, then each pattern in order, without repeats, the first five."""
    seen = F.array_compact(F.array(*(F.when((category == k) & (visual_confidence > 0.5), said) for k, said in VISUAL_FLAGS.items())))

    def flag(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, (said, quoted) in PATTERN_FLAGS.items():
            out = F.when(p["type"] == kind, F.concat(F.lit(f'{said}: "'), p["matchedText"], F.lit('"')) if quoted else F.lit(said)).otherwise(out)
        return out

    return F.slice(F.array_distinct(F.concat(seen, F.transform(patterns, flag))), 1, most)


def safety_tips(score: Column, types: Column | dict[str, Column], most: int = 5) -> Column:
    """General tips above the middle, tips by family, two last ones if high; without repeats, the first five."""
    tips = [F.when(score > MEDIUM, t) for t in GENERAL_TIPS]
    tips += [F.when(_has(types, kind), t) for kind, said in PATTERN_TIPS.items() for t in said]
    tips += [F.when(score > HIGH, t) for t in LAST_TIPS]
    return F.slice(F.array_distinct(F.array_compact(F.array(*tips))), 1, most)


def user_risk_band(score: Column) -> Column:
    return F.when(score >= 80, "High Risk").when(score >= 50, "Medium Risk").when(score >= 20, "Low Risk").otherwise("Protected")


def scan_state(level: Column) -> Column:
    return F.when(level.isin("critical", "high"), "DANGER").when(level == "medium", "SUSPICIOUS").otherwise("SAFE")
