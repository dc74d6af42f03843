"""Verdicts on announcements and articles by words and places, each with what led to it."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lathework.functions import words

REASONS = ["region", "over", "unwanted", "mildly_unwanted", "no_keyword"]


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Full-width and other compatibility forms as plain ones; null is empty."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x) if x else "")


def holds(text: Column, keyword: str) -> Column:
    """Whether the text has the keyword. Keywords of plain letters mind case and never begin within a word."""
    if keyword in words.KEYWORD_PATTERNS:
        return text.rlike(words.KEYWORD_PATTERNS[keyword])
    if not keyword.isascii():
        return F.contains(text, F.lit(keyword))
    before = "0-9" if keyword[0].isdigit() else "A-Za-z"
    return text.rlike(rf"(?<![{before}])\Q{keyword}\E" + ("(?![A-Za-z])" if keyword in words.WHOLE else ""))


def first_held(text: Column, keywords: list[str]) -> Column:
    """The first of the list that the text has, in the list's order."""
    return F.coalesce(*[F.when(holds(text, k), k) for k in keywords])


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """What the first fitting pattern fits."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 0)) for p in patterns])


def _place(name: str) -> str:
    return words.REGION_PATTERNS.get(name, re.escape(name))


def first_place(text: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.when(text.rlike(_place(n)) if n in words.REGION_PATTERNS else F.contains(text, F.lit(n)), n) for n in names])


def _any_place(text: Column, names: list[str]) -> Column:
    return text.rlike("|".join(_place(n) for n in names))


def region_verdict(title: Column, category: Column, department: Column) -> Column:
    """(verdict, reason): allow, exclude or nationwide, by the first rule that fits.

    The rules: a provincial department; tenders, whose places are where work is done; up to three tags in front; far
    places; places that may be far, if no near one is named; near places. Arguments have to be `compatible`.
    """
    department = F.trim(department)
    say = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason"))
    provincial = department.rlike("(?:시|도)$") & department.rlike("(?:특별시|광역시|특별자치시|도)$") & ~department.rlike("(?:부|처|청|원|위원회)$")
    out = F.when(provincial & department.rlike("^(?:서울|경기)"), say("allow", department)).when(provincial, say("exclude", department))
    out = out.when(category.rlike(words.TENDERS), say("nationwide", category))
    tag = r"\s*[\[(【〔]\s*({}[^\[\]()【】〔〕]*?)\s*[\])】〕]"
    for n in range(3):
        inside = F.regexp_extract(title, "^(?:" + tag.format("?:") + f"){{{n}}}" + tag.format(""), 1)
        far = _any_place(inside, words.FAR) | reduce(Column.__or__, [holds(inside, w) for w in words.FAR_AS_TAG]) | inside.rlike("|".join(words.UNSURE))
        out = out.when(_any_place(inside, words.NEAR), say("allow", inside)).when(far, say("exclude", inside))
    text = F.concat_ws(" ", *[F.when(c != "", c) for c in (title, category, department)])
    text = F.regexp_replace(text, r"경기(?:도)?\s*광주(?:시)?", "경기")
    far, near, unsure = first_place(text, words.FAR), first_place(text, words.NEAR), first_pattern(text, words.UNSURE)
    out = out.when(far.isNotNull(), say("exclude", far)).when(near.isNotNull(), say("allow", near)).when(unsure.isNotNull(), say("exclude", unsure))
    return out.otherwise(say("nationwide", F.lit("")))


def with_verdict(rows: DataFrame, title: str = "title", category: str = "category", department: str = "department") -> DataFrame:
    """`rows` with `reason` (null if the row stays, else one of REASONS), `detail` and `overridden`.

    Unwanted words count in title and category, and strong ones, which override them, in the title alone.
    """
    plain = rows.withColumns({"_t": compatible(title), "_c": compatible(category), "_d": compatible(department)}).withColumn("_b", F.concat("_t", F.lit(" "), "_c"))
    t, body = F.col("_t"), F.col("_b")
    found = plain.withColumns({
        "_region": region_verdict(t, F.col("_c"), F.col("_d")), "_over": first_pattern(body, words.OVER), "_bad": first_held(body, words.UNWANTED),
        "_mild": first_held(body, words.MILDLY_UNWANTED), "_good": first_held(body, words.WANTED), "_strong": first_held(t, words.STRONG).isNotNull(),
    })
    bad = F.coalesce("_bad", "_mild")
    reason = (
        F.when(F.col("_region.verdict") == "exclude", "region")
        .when(F.col("_over").isNotNull(), "over")
        .when(F.col("_bad").isNotNull() & ~F.col("_strong"), "unwanted")
        .when(F.col("_mild").isNotNull() & ~F.col("_strong"), "mildly_unwanted")
        .when(F.col("_good").isNull(), "no_keyword")
    )
    judged = found.withColumn("reason", reason)
    detail = F.when(F.col("reason") == "region", F.col("_region.reason")).when(F.col("reason") == "over", F.col("_over")).when(F.col("reason") == "no_keyword", "").otherwise(F.coalesce(bad, "_good"))
    overridden = F.coalesce(~F.col("reason").isin(REASONS[:4]), F.lit(True)) & bad.isNotNull()
    return judged.select(*rows.columns, "reason", detail.alias("detail"), overridden.alias("overridden"))


def keyword_score(text: Column, full: int = 5) -> Column:
    found = reduce(Column.__add__, [holds(text, k).cast("int") for k in words.WANTED])
    return F.least(F.coalesce(found, F.lit(0)) / F.lit(float(full)), F.lit(1.0))


# The rules that stand in for a judge of articles.
_ALONE = "(?<![A-Za-z])(?:{})(?![A-Za-z])"
AI_WORDS = _ALONE.format(r"AI|A\.I\.|AX|LLM|sLLM|GPT|RAG|GenAI")
AI_PHRASES = r"(?iu)인공지능|생성형|에이전트|파운데이션\s?모델|거대언어|머신러닝|딥러닝|artificial intelligence|generative|agentic|retrieval[- ]augmented|machine learning|large language model"
DRAWINGS = r"도면|설계도|P&ID|building information model|(?i:construction drawings?|engineering drawings?)|" + _ALONE.format("BIM")
TRADES = (
    r"건설|건축|플랜트|엔지니어링|시공|토목|디지털\s?트윈|스마트\s?건설|이앤씨|" + _ALONE.format("E&C|E&A|EPC|AEC|CAD")
    + r"|(?i:\bconstruction\b|\bcontractors?\b|homebuilders?|\barchitects?\b|architecture firms?|built environment|digital twins?|\bblueprints?\b)"
)
INFRASTRUCTURE = r"데이터\s?센터|AIDC|AI\s?DC(?![A-Za-z])|발전소|(?i:data cent(?:er|re)s?|power plants?)"
NOISE = r"특징주|목표가|주가|(?i:\bETFs?\b|\bstocks?\b|\bshares\b|\bNFTs?\b|European Political Community|Edgewell|EPC Group|Canadian dollar|floor price)"
RETRIEVAL = r"(?i)" + _ALONE.format("RAG") + r"|retrieval[- ]augmented|검색\s?증강"
# Titles that say nothing, and pages that ask for a proof of being human.
EMPTY_TITLE = r"(?i)^(?:untitled|속보서비스|.{0,3})$"
CHALLENGE = r"(?i)Incapsula incident|Request unsuccessful|Just a moment|Checking your browser|Enable JavaScript and cookies|Attention Required|Access Denied|captcha|비정상적인 접근|자동입력 방지"


# What a text in small letters has at least one of if a pattern fits it.
_HEADS = {
    AI_WORDS: ["ai", "a.i.", "ax", "llm", "gpt", "rag"],
    AI_PHRASES: ["인공지능", "생성형", "에이전트", "파운데이션", "거대언어", "머신러닝", "딥러닝", "artificial", "generative", "agentic", "retrieval", "machine learning", "large language model"],
    DRAWINGS: ["도면", "설계도", "p&id", "building information model", "drawing", "bim"],
    TRADES: [
        "건설", "건축", "플랜트", "엔지니어링", "시공", "토목", "디지털", "이앤씨", "e&c", "e&a", "epc", "aec", "cad",
        "construction", "contractor", "homebuilder", "architect", "built environment", "digital twin", "blueprint",
    ],
    INFRASTRUCTURE: ["데이터", "ai", "발전소", "data cent", "power plant"],
    NOISE: ["특징주", "목표가", "주가", "etf", "stocks", "stock", "shares", "nft", "european political community", "edgewell", "epc group", "canadian dollar", "floor price"],
    RETRIEVAL: ["rag", "retrieval", "검색"],
}


def _fits(t: Column, pattern: str) -> Column:
    """Whether a pattern fits; plain searches for its heads spare most texts the pattern."""
    return reduce(Column.__or__, [F.contains(t["low"], F.lit(h)) for h in _HEADS[pattern]]) & t["text"].rlike(pattern)


def triage(title: Column, snippet: Column) -> Column:
    """(outcome, score, theme) of an article by rules: main, infra or rejected. What a rule does not need is not looked for."""
    text = F.concat_ws(" ", title, snippet)
    say = lambda outcome, score, theme: F.struct(F.lit(outcome).alias("outcome"), F.lit(score).cast("double").alias("score"), F.lit(theme).cast("string").alias("theme"))

    def judged(t: Column) -> Column:
        ai, strong, trade = _fits(t, AI_WORDS) | _fits(t, AI_PHRASES), _fits(t, DRAWINGS), _fits(t, TRADES)
        traded = (
            F.when(_fits(t, INFRASTRUCTURE), say("infra", 0.4, None))
            .when(_fits(t, RETRIEVAL), say("main", 0.6, "aec_rag"))
            .otherwise(say("main", 0.6, "aec_ai"))
        )
        # Without AI, and with noise but no drawings, all is rejected.
        weak = F.when(_fits(t, NOISE), say("rejected", None, None)).when(trade, traded).otherwise(say("rejected", None, None))
        return F.when(~ai, say("rejected", None, None)).when(strong, say("main", 0.8, "drawing_bim")).otherwise(weak)

    return F.element_at(F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), judged), 1)


def right_language(title: Column, korean: Column) -> Column:
    """Whether a title is in Hangul where it should be, and only there."""
    return title.rlike("[가-힣]") == korean


def in_window(at: Column, start: Column, now: Column) -> Column:
    """Published from `start` to an hour from now; unknown times are out."""
    return F.coalesce(at.between(start, now + F.expr("INTERVAL 1 HOUR")), F.lit(False))


def challenge_page(text: Column) -> Column:
    return (F.length(text) < 600) & text.rlike(CHALLENGE)


def with_judgement(rows: DataFrame, no: str, verdicts: DataFrame, least: float) -> DataFrame:
    """`rows` with `score` and `outcome`: passed, rejected, or unjudged for rows that no valid verdict names.

    `verdicts` has (no, score, at); the first for each number counts, scores are brought within 0 and 1, numbers without
    a score don't count. Unjudged rows must not enter a cache of rejections.
    """
    valid = verdicts.where(F.col("score").isNotNull() & ~F.isnan("score"))
    first = valid.groupBy(F.col("no").alias("v_no")).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min_by("score", "at"))).alias("v_score"))
    outcome = F.when(F.col("v_score").isNull(), "unjudged").when(F.col("v_score") >= least, "passed").otherwise("rejected")
    return rows.join(first, F.col(no) == F.col("v_no"), "left").select(*[c for c in rows.columns if c != "score"], F.col("v_score").alias("score"), outcome.alias("outcome"))


def circuit_open(judged: DataFrame, order: str, first: int = 3, share: float = 0.5) -> bool:
    """Whether a judge is to be left alone: the first scores have all failed, or `first` and at least the share of all."""
    all_of_first = judged.orderBy(order).limit(first).where("score IS NULL").count() == first
    failed, n = judged.agg(F.count_if(F.col("score").isNull()), F.count("*")).first()
    return all_of_first or (failed >= first and failed >= share * n)
