"""Mail: messages out of the wire form, cleanup verdicts, threads, and the text of a digest. The owner is an argument."""

from __future__ import annotations

from email.utils import parseaddr

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lathework.functions.text import page_text
from lathework.operators.filters import first_match
from lathework.operators.lineage import cut
from lathework.operators.sequence import running_sum

# Where the quotation in a reply begins, mailboxes that anyone can have, and labels.
QUOTE_STARTS = [
    r"^-{2,}\s*Original Message\s*-{2,}",
    r"^-{2,}\s*원본 메시지\s*-{2,}",
    r"^_{10,}\s*\n\s*(보낸 사람|From)\s*:",
    r"^(보낸 사람|From)\s*:[^\n]*\n\s*(보낸 날짜|Sent|Date)\s*:",
    r"^On [^\n]{1,250}(\n[^\n]{1,250})?wrote:\s*$",
    r"^[^\n]{1,250}님이 작성:\s*$",
]
FREE_MAIL = "gmail.com naver.com daum.net hanmail.net kakao.com nate.com outlook.com hotmail.com yahoo.com icloud.com".split()
PROTECTED, NOT_RECEIVED = ["SENT", "DRAFT", "STARRED"], ["SENT", "DRAFT", "TRASH", "SPAM"]
#: Longest texts of a thread's latest message, of what it quotes, and of earlier messages; of all threads together.
LATEST, QUOTED, EARLIER, TOTAL = 3000, 1500, 800, 150_000

_QUOTE = "(?im)" + "|".join(f"(?:{p})" for p in QUOTE_STARTS)

PART = "mimeType: string, filename: string, body: struct<data: string>"


def raw_schema(depth: int = 4) -> str:
    """The type of a message as delivered, its parts nested to a bounded depth."""
    part = f"struct<{PART}>"
    for _ in range(depth):
        part = f"struct<{PART}, parts: array<{part}>>"
    top = part.replace("struct<", "struct<headers: array<struct<name: string, value: string>>, ", 1)
    return f"id string, threadId string, labelIds array<string>, internalDate string, snippet string, payload {top}"


def tidy(text: Column) -> Column:
    """Line ends, blanks and empty lines made plain."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), " ", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, "​", ""), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, " *\n *", "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def decoded(data: Column) -> Column:
    """Text of an address-safe base64 string without padding."""
    plain = F.translate(data, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.decode(F.unbase64(padded), "UTF-8")


def _leaves(part: Column, kind: StructType) -> Column:
    """A part and all parts below it, in order, without their nesting."""
    flat = F.array(F.struct(F.lower(F.coalesce(part["mimeType"], F.lit(""))).alias("mime"), F.coalesce(part["filename"], F.lit("")).alias("filename"), part["body"]["data"].alias("data")))
    if "parts" not in kind.names:
        return flat
    below = kind["parts"].dataType.elementType
    return F.concat(flat, F.flatten(F.transform(F.coalesce(part["parts"], F.array().cast(kind["parts"].dataType)), lambda p: _leaves(p, below))))


@F.pandas_udf(StringType())
def _html(text: pd.Series) -> pd.Series:
    return text.map(page_text, na_action="ignore")


@F.pandas_udf(StructType([StructField("name", StringType()), StructField("address", StringType())]))
def _address(header: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(n.strip(), a.strip().lower()) for n, a in header.map(lambda x: parseaddr(x or ""))], columns=["name", "address"])


def messages(raw: DataFrame) -> DataFrame:
    """One row for each message: headers, sender, new text and quotation, attachments but images, labels, time in ms.

    Of repeated headers the last counts. Plain parts win over markup; a message without either has an empty text.
    """
    leaves = _leaves(F.col("payload"), raw.schema["payload"].dataType)
    header = lambda name: F.try_element_at(F.filter("payload.headers", lambda h: F.lower(h["name"]) == name), F.lit(-1))["value"]
    named = lambda x: (x["filename"] != "") & ~F.startswith(x["mime"], F.lit("image/"))
    text_of = lambda kind: F.transform(F.filter("_leaves", lambda x: ~named(x) & (x["mime"] == kind) & (F.coalesce(x["data"], F.lit("")) != "")), lambda x: decoded(x["data"]))
    opened = raw.withColumn("_leaves", leaves).withColumn("_plain", text_of("text/plain")).withColumn("_markup", text_of("text/html")).withColumn("_from", _address(header("from")))
    text = F.when(F.size("_plain") > 0, F.array_join("_plain", "\n\n")).when(F.size("_markup") > 0, _html(F.array_join("_markup", "\n"))).otherwise("")
    split = opened.withColumn("_split", split_quoted(tidy(text)))
    return split.select(
        "id", F.coalesce("threadId", "id").alias("thread_id"), F.col("_from.name").alias("from_name"), F.col("_from.address").alias("from_addr"),
        F.coalesce(header("to"), F.lit("")).alias("to"), F.coalesce(header("cc"), F.lit("")).alias("cc"), F.coalesce(F.nullif(header("subject"), F.lit("")), F.lit("(no subject)")).alias("subject"),
        F.coalesce(F.col("internalDate").try_cast("bigint"), F.lit(0)).alias("at_ms"), F.coalesce("labelIds", F.array().cast("array<string>")).alias("labels"), tidy(F.coalesce("snippet", F.lit(""))).alias("snippet"),
        F.col("_split.body").alias("body"), F.col("_split.quoted").alias("quoted"), F.transform(F.filter("_leaves", named), lambda x: x["filename"]).alias("attachments"),
    )


def split_quoted(text: Column) -> Column:
    """(body, quoted) of a reply. With under 20 characters of its own and something quoted, all is body."""
    at = F.regexp_instr(text, F.lit(_QUOTE))
    head, tail = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")
    lines = F.split(head, "\n")
    marked = lambda x: F.startswith(F.ltrim(x), F.lit(">"))
    body = tidy(F.array_join(F.filter(lines, lambda x: ~marked(x)), "\n"))
    quoted = tidy(F.concat(F.array_join(F.transform(F.filter(lines, marked), lambda x: F.trim(F.substring(F.ltrim(x), F.lit(2), F.length(x)))), "\n"), F.lit("\n"), tail))
    whole = (F.length(body) < 20) & (quoted != "")
    return F.struct(F.when(whole, tidy(text)).otherwise(body).alias("body"), F.when(whole, "").otherwise(quoted).alias("quoted"))


def sender(name: Column, address: Column, own_domain: str) -> Column:
    """A sender's name, without the group it came by, and the company's domain behind it."""
    via = F.regexp_extract(name, "^'?(.+?)'? via .+$", 1)
    shown = F.trim(F.trim(F.when(via != "", via).otherwise(name)), F.lit("'\""))
    shown = F.when(F.coalesce(shown, F.lit("")) == "", address).otherwise(shown)
    domain = F.when(F.contains(address, F.lit("@")), F.substring_index(address, "@", -1)).otherwise("")
    told = (domain != "") & (domain != own_domain) & ~domain.isin(FREE_MAIL) & ~F.contains(shown, domain)
    return F.when(told, F.concat(shown, F.lit(" ("), domain, F.lit(")"))).otherwise(shown)


def cleanup_category(after_ms: Column) -> Column:
    """What a message is to be cleared away as, by the first rule that fits; null if it stays.

    Mail from before `after_ms` and mail that was sent, drafted or starred always stays.
    """
    subject, address = F.col("subject"), F.col("from_addr")
    open_ = (F.col("at_ms") >= after_ms) & ~F.arrays_overlap("labels", F.array(*map(F.lit, PROTECTED)))
    google = (address == "no-reply@accounts.google.com") & F.trim(subject).rlike("^(?:보안 알림|Security alert)")
    # Categories and what belongs to them, in order.
    rules = [
        ("advert", subject.rlike(r"^\s*[(\[]\s*광고\s*[)\]]")),
        ("declined", subject.rlike(r"(?i)^\s*(거절함|거절됨|Declined)\s*:")),
        ("repository", address == "notifications@github.com"),
        ("security", google),
        ("security", (address == "no-reply@sns.amazonaws.com") & (F.col("from_name") == "aws-controltower-AggregateSecurityNotifications")),
    ]
    return F.when(open_, first_match(rules))


def threads(mail: DataFrame, after_ms: int, owner: str, excluded: list[str]) -> DataFrame:
    """(thread_id, n, important, recipient, latest, replied) of what arrived since `after_ms`, the owner's replies aside.

    `replied` tells whether the owner wrote after the latest message; `recipient` is to, cc or group by that message.
    """
    since = mail.where(F.col("at_ms") >= after_ms)
    got = since.where((F.col("from_addr") != owner) & ~F.col("from_addr").isin(excluded) & ~F.arrays_overlap("labels", F.array(*map(F.lit, NOT_RECEIVED))))
    latest = F.max_by(F.struct("id", "subject", "from_name", "from_addr", "to", "cc", "body", "snippet", "quoted", "at_ms"), F.struct("at_ms", "id"))
    each = got.groupBy("thread_id").agg(F.count("*").alias("n"), F.bool_or(F.array_contains("labels", "IMPORTANT")).alias("important"), latest.alias("latest"))
    sent = since.where(F.array_contains("labels", "SENT")).groupBy("thread_id").agg(F.max("at_ms").alias("_sent"))
    kind = F.when(F.contains(F.lower("latest.to"), F.lit(owner)), "to").when(F.contains(F.lower("latest.cc"), F.lit(owner)), "cc").otherwise("group")
    return each.join(sent, "thread_id", "left").select("thread_id", "n", "important", kind.alias("recipient"), "latest", F.coalesce(F.col("_sent") > F.col("latest.at_ms"), F.lit(False)).alias("replied"))


def thread_texts(mail: DataFrame, total: int = TOTAL) -> DataFrame:
    """(thread_id, text): threads as text, within a total of characters.

    Where the total is over, the oldest unimportant threads give up their bodies first and keep the preview. The threads
    of one report are few, but all of a mailbox need not be: the running total is one over a distributed sort.
    """
    nth = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.col("at_ms").desc(), F.col("id").desc()))
    clipped = lambda c, n: F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit(" …("), (F.length(c) - n).cast("string"), F.lit(" omitted)"))).otherwise(c)
    body = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("snippet"))
    head = F.concat(F.lit("-- "), "from_name", F.lit("\n"))
    rows = mail.withColumn("_nth", nth)
    whole = F.concat(head, F.when(F.col("_nth") == 1, F.concat(clipped(body, LATEST), F.when(F.col("quoted") != "", F.concat(F.lit("\n> "), clipped(F.col("quoted"), QUOTED))).otherwise(""))).otherwise(clipped(body, EARLIER)))
    in_order = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at_ms", "id", c.alias("t")))), lambda x: x["t"]), "\n")
    each = rows.groupBy("thread_id").agg(in_order(whole).alias("_whole"), in_order(F.concat(head, "snippet")).alias("_short"), F.bool_or(F.array_contains("labels", "IMPORTANT")).alias("_important"), F.max("at_ms").alias("_at"))
    each = cut(each)
    sizes = each.select("thread_id", "_important", "_at", F.length("_whole").alias("_full"), (F.length("_whole") - F.length("_short")).alias("_saves"))
    over = (sizes.agg(F.sum("_full")).collect()[0][0] or 0) - total  # one number
    order = [F.col("_important"), F.col("_at"), F.col("thread_id")]
    # A body goes as long as those before it have not saved enough.
    short = running_sum(sizes, order, F.col("_saves"), "_sum").where(F.col("_sum") - F.col("_saves") < over).select("thread_id", F.lit(True).alias("_cut"))
    told = each.join(short, "thread_id", "left")
    return told.select("thread_id", F.when(F.col("_cut"), F.col("_short")).otherwise(F.col("_whole")).alias("text"))


def frequent(mail: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, the first seen first among equals. The limit is the feature."""
    return mail.groupBy(column).agg(F.count("*").alias("n"), F.min(F.struct("at_ms", "id")).alias("_first")).orderBy(F.col("n").desc(), "_first").limit(n).drop("_first")


def relabelled(labels: Column, add: list[str], remove: list[str]) -> Column:
    return F.array_except(F.array_union(labels, F.array(*map(F.lit, add)).cast(ArrayType(StringType()))), F.array(*map(F.lit, remove)).cast(ArrayType(StringType())))
