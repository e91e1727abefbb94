"""Text columns: lexicon scores, patterns, prediction lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktote.functions.core import clip, col, sdiv


def parse_prediction_line(df: DataFrame, line: str) -> DataFrame:
    """"4-2,1,3-5": favourite, second candidate and all recommended cars in order."""
    cars = F.transform(F.regexp_extract_all(line, F.lit(r"([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    d = df.withColumn("recommended", F.array_distinct(cars))
    return d.withColumns({"favourite": F.try_element_at("recommended", F.lit(1)), "second": F.try_element_at("recommended", F.lit(2)), "third": F.try_element_at("recommended", F.lit(3))})


def occurrences(text: str | Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(word)))) / len(word)).cast("int")


def hourly_mean(df: DataFrame, ts: str, x: str) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", ts).cast("timestamp_ntz").alias(ts)).agg(F.avg(x).alias(x))


# Keyword weights of rider comments.
POSITIVE_KEYWORDS = {
    "絶好調": 1.0, "絶好": 1.0, "最高": 1.0, "快調": 1.0, "勝てる": 1.0, "勝機": 1.0, "自信": 1.0, "楽勝": 1.0, "復活": 1.0, "復調": 0.8, "絶対": 0.8,
    "好調": 0.6, "調子": 0.5, "上向き": 0.6, "余裕": 0.6, "狙える": 0.7, "狙う": 0.5, "勝負": 0.6, "頑張": 0.3, "しっかり": 0.4, "力": 0.3, "問題ない": 0.6,
    "悪くない": 0.4, "いい": 0.3, "良い": 0.3, "まずまず": 0.3, "動ける": 0.4, "仕上がった": 0.5, "万全": 0.8,
}
NEGATIVE_KEYWORDS = {
    "絶望": -1.0, "最悪": -1.0, "無理": -1.0, "勝負にならない": -1.0, "厳しい": -0.7, "きつい": -0.6, "苦しい": -0.7,
    "不調": -0.7, "悪い": -0.5, "ダメ": -0.7, "だめ": -0.7, "疲れ": -0.5, "疲労": -0.5, "痛い": -0.5, "出遅れ": -0.4, "乗れない": -0.6, "合わない": -0.4,
    "難しい": -0.4, "わからない": -0.2, "不安": -0.5, "心配": -0.4, "微妙": -0.3, "まだ": -0.1,
}
INJURY_KEYWORDS = {"怪我": 1.0, "けが": 1.0, "負傷": 1.0, "故障": 1.0, "痛み": 0.7, "違和感": 0.6, "張り": 0.4, "腰": 0.3, "膝": 0.3, "足": 0.2}
CONFIDENT = ["絶対", "必ず", "自信", "間違いな", "確実", "任せ", "勝てる", "絶好調"]
DOUBTFUL = ["どうか", "わからな", "たぶん", "かもしれな", "かな", "どうだろう", "難しい"]
NEGATION = r"ない\b|ぬ\b|ません"


def keyword_sentiment(
    df: DataFrame,
    text: str,
    weights: dict[str, float] | None = None,
    injury: dict[str, float] | None = None,
    confident: list[str] | None = None,
    doubtful: list[str] | None = None,
    negation: str = NEGATION,
) -> DataFrame:
    """Comment scores: tanh of half the weighted keyword sum (a negation halves a positive
    score), confidence from sure and unsure words, worst injury word, counts, length.

    The keywords are looked up in one pass over the whole text, whatever their number; a word inside a longer keyword
    counts for both.
    """
    from ticktote.functions.lexicon import counts_by_value, lexicon_hits

    weights = weights if weights is not None else {**POSITIVE_KEYWORDS, **NEGATIVE_KEYWORDS}
    injury = injury if injury is not None else INJURY_KEYWORDS
    confident = confident if confident is not None else CONFIDENT
    doubtful = doubtful if doubtful is not None else DOUBTFUL
    c = F.col(text)
    d = df.withColumn("_hit", lexicon_hits(c, [*weights, *injury, *confident, *doubtful]))
    counted = lambda values: counts_by_value(c, F.col("_hit"), values)
    by_weight = counted(weights)
    total = sum((F.lit(v) * n for v, n in by_weight.items()), F.lit(0.0))
    count = lambda keep: sum((n for v, n in by_weight.items() if keep(v)), F.lit(0))
    hi = sum(counted(dict.fromkeys(confident, 1.0)).values(), F.lit(0))
    lo = sum(counted(dict.fromkeys(doubtful, 1.0)).values(), F.lit(0))
    inj = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(n > 0, F.lit(v)).otherwise(0.0) for v, n in counted(injury).items()])
    d = d.withColumns({"_total": total, "_hi": hi, "_lo": lo})
    raw = F.tanh(F.col("_total") / 2)
    blank = c.isNull() | (F.trim(c) == "")
    some = F.col("_hi") + F.col("_lo")
    conf = F.when(some > 0, (F.col("_hi") - F.col("_lo")) / (some + 1) * 0.5 + 0.5).otherwise(0.5)
    zero = lambda x, z: F.when(blank, z).otherwise(x)
    return d.withColumns({
        "sentiment_score": zero(F.when(c.rlike(negation) & (raw > 0), raw * 0.5).otherwise(raw), 0.0),
        "confidence_score": zero(conf, 0.0),
        "injury_flag": zero(inj, 0.0),
        "n_positive": zero(count(lambda v: v > 0), 0),
        "n_negative": zero(count(lambda v: v < 0), 0),
        "length": zero(F.length(c), 0),
    }).drop("_hit", "_total", "_hi", "_lo")


def rule_sentiment(df: DataFrame, text: str, lexicon: dict[str, float]) -> DataFrame:
    """Mean weight of the words present, clamped to [-1, 1], with label and confidence."""
    t = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(t.contains(w), F.lit(float(v))) for w, v in lexicon.items()]))
    d = df.withColumn("_h", hits).withColumn("n_hits", F.size("_h"))
    s = F.aggregate("_h", F.lit(0.0), lambda a, e: a + e)
    d = d.withColumn("score", F.coalesce(clip(sdiv(s, F.col("n_hits").cast("double")), -1, 1), F.lit(0.0)))
    x = F.round("score", 9)
    lab = F.when(x >= 0.3, "positive").when(x <= -0.3, "negative").when(F.col("n_hits") == 0, "skip").otherwise("neutral")
    return d.withColumns({"label": lab, "confidence": F.least(F.lit(0.9), 0.5 + F.abs(x) * 0.4)}).drop("_h")


# News whose meaning depends on what else is said.
CONTEXT_PATTERNS = ("CEO.{0,10}辞任", "買収.{0,15}提携", "規制.{0,20}発表", "後任", "条件付き")


def needs_context(df: DataFrame, text: str, patterns: tuple[str, ...] = CONTEXT_PATTERNS) -> DataFrame:
    """Whether any of the patterns occurs; a null text needs none."""
    return df.withColumn("needs_context", F.coalesce(F.col(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)).cast("int"))


def news_targets(df: DataFrame, text: str, sectors: dict[str, list[str]], inverse: dict[str, list[str]]) -> DataFrame:
    """Codes named directly, codes of sectors named, codes that move against an event named."""
    t = F.lower(text)
    direct = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{4}(?:\.T)?)\b"), F.lit(1))))

    def mapped(m: dict[str, list[str]]) -> Column:
        parts = [F.when(t.contains(k), F.array(*[F.lit(x) for x in v])).otherwise(F.array().cast("array<string>")) for k, v in m.items()]
        return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))

    return df.withColumns({"direct": direct, "sector": mapped(sectors), "inverse": mapped(inverse)})


def first_pattern(text: str | Column, patterns: dict[str, str], default: str) -> Column:
    """Name of the first pattern that matches."""
    out = None
    for name, p in patterns.items():
        c = col(text).rlike(p)
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(default)


# What a comment says about a rider's role, in order of precedence.
INTENT_PATTERNS = {
    "lead": r"(?i)先行|自力|前から|前で|逃げ|先手で|先頭で|take the lead|lead out",
    "single": r"(?i)単騎|一人で|自分で|単独|\balone\b",
    "follow": r"(?i)\S+(?:選手|君)(?:を追|の後ろ|の番手|に付|につ)|\S+番(?:の後ろ|後ろ|の番手|番手|を追)|follow(?:s|ing)?(?: the)? \w+",
    "second": r"(?i)番手|後ろにつ|後ろつ|マーク|ついて行|second wheel",
}
# Whom a comment follows, by name or by number; group 1.
TARGET_PATTERNS = (
    r"(\S+?)(?:選手|君)(?:を追|の後ろ|の番手|に付|につ)",
    r"(\S+?)番(?:の後ろ|後ろ|の番手|番手|を追)",
    r"(?i)follow(?:s|ing)?(?: the)? (\w+)",
)
INTENT_CONFIDENCE = {"lead": 0.8, "single": 0.8, "follow": 0.7, "second": 0.7, "unknown": 0.3}


def comment_intent(df: DataFrame, text: str) -> DataFrame:
    """First matching family: role (second counts as follow), target name or number, and confidence.

    A null or blank comment says nothing: unknown.
    """
    fam = F.coalesce(first_pattern(text, INTENT_PATTERNS, "unknown"), F.lit("unknown"))
    d = df.withColumn("_f", fam)
    target = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in TARGET_PATTERNS])
    conf = F.coalesce(*[F.when(F.col("_f") == k, F.lit(v)) for k, v in INTENT_CONFIDENCE.items()])
    return d.withColumns({
        "role": F.when(F.col("_f") == "second", "follow").otherwise(F.col("_f")),
        "target": F.when(F.col("_f") == "follow", target),
        "confidence": conf}).drop("_f")
