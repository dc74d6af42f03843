"""Articles into stories: merging of copies, story numbers, repeats of what was sent, and the queries that find articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.operators.lineage import cut


def merge_copies(rows: DataFrame, order: str, keys: list[str], lists: list[str], first_known: list[str]) -> DataFrame:
    """One row for each article, found under several keys.

    In `order`, which is unique, a row that shares a key with an earlier row is a copy of the row that key belongs to and
    brings its other keys along; keys that already belong to a row stay with it, so a row that bridges two kept ones joins
    the one of its first known key and does not fuse them. Lists are united in order of first sight, `first_known` columns
    take the first value that is not null or empty.

    Rows of the same keys belong together and count as their first. Such a row points at the first row of its first known
    key, which is earlier, and the pointers are followed by doubling over checkpoints: no linked group meets in one task,
    and what is collected for a row are the distinct values of its lists.
    """
    known_keys = F.array_compact(F.array(*[F.concat(F.lit(f"{i}:"), F.col(k)) for i, k in enumerate(keys)]))
    folded = cut(rows.select(F.col(order).alias("_at"), known_keys.alias("_keys")).where(F.size("_keys") > 0).groupBy("_keys").agg(F.min("_at").alias("_at")))
    by_key = folded.select("_at", F.posexplode("_keys").alias("_n", "_key"))
    first = by_key.groupBy("_key").agg(F.min("_at").alias("_first"))
    links = cut(by_key.join(first, "_key").where(F.col("_first") < F.col("_at")).groupBy("_at").agg(F.min_by("_first", "_n").alias("_owner")))
    while True:
        ahead = links.select(F.col("_at").alias("_owner"), F.col("_owner").alias("_next"))
        moved = cut(links.join(ahead, "_owner", "left").select("_at", F.coalesce("_next", "_owner").alias("_owner"), F.col("_next").isNotNull().alias("_moved")))
        links = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    owners = cut(folded.join(links, "_at", "left").select("_keys", F.coalesce("_owner", "_at").alias("_owner")))
    placed = rows.withColumn("_keys", known_keys).join(owners, "_keys", "left").withColumn("_owner", F.coalesce("_owner", order)).drop("_keys")
    known = lambda c: F.min_by(F.col(c), F.struct((F.col(c).isNull() | (F.col(c).cast("string") == "")).cast("int"), F.col(order)))
    out = placed.groupBy("_owner").agg(*[(known(c) if c in first_known else F.min_by(c, order)).alias(c) for c in rows.columns if c not in lists])
    for c in lists:
        seen = placed.select("_owner", F.col(order).alias("_at"), F.posexplode(c).alias("_n", "_value"))
        values = seen.groupBy("_owner", "_value").agg(F.min(F.struct("_at", "_n")).alias("_first"))
        united = values.groupBy("_owner").agg(F.sort_array(F.collect_list(F.struct("_first", "_value")))["_value"].alias(c))
        out = out.join(united, "_owner", "left").withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    return out.select(*rows.columns)


def by_canonical_url(rows: DataFrame, url: Column, order: str) -> DataFrame:
    """The first row of each address; rows without one all stay."""
    key = F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("row "), F.col(order).cast("string")))
    return rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def story_numbers(rows: DataFrame, no: str, said: str, group: str) -> DataFrame:
    """`rows` with `story`: the number of the leading article, chains followed to their beginning.

    `said` is the earlier number that an article is said to tell the same as. It counts if it is no later number and of the
    same `group`; else the article stands alone. References go back only, so doubling the steps ends after a number of
    rounds that is the logarithm of the longest chain.
    """
    held = rows.select(F.col(no).alias("_lead"), F.col(group).alias("_group"))
    valid = F.col("_lead").isNotNull() & (F.col(said) <= F.col(no)) & F.col(group).eqNullSafe(F.col("_group"))
    steps = cut(rows.join(held, F.col(said) == F.col("_lead"), "left").select(F.col(no).alias("_no"), F.when(valid, F.col(said)).otherwise(F.col(no)).alias("_story")))
    while True:
        ahead = steps.select(F.col("_no").alias("_story"), F.col("_story").alias("_next"))
        steps, last = cut(steps.join(ahead, "_story").select("_no", F.col("_next").alias("_story"), (F.col("_next") != F.col("_story")).alias("_moved"))), steps
        if steps.where("_moved").isEmpty():
            break
        steps = steps.drop("_moved")
    return rows.join(last.select("_no", F.col("_story").alias("story")), F.col(no) == F.col("_no")).drop("_no")


def drop_told(tiers: list[DataFrame], story: str, history: DataFrame) -> list[DataFrame]:
    """Each tier without the stories that the history or an earlier tier has told."""
    told, out = history.select(story), []
    for tier in tiers:
        out.append(tier.join(told, story, "left_anti"))
        told = told.unionByName(tier.select(story))
    return out


def top_stories(rows: DataFrame, story: str, rank: list[Column], n: int) -> DataFrame:
    """All rows of the first n stories, each placed by its best row; the rest may come later."""
    names = [f"r{i}" for i in range(len(rank))]
    best = rows.groupBy(story).agg(F.min(F.struct(*[c.alias(k) for c, k in zip(rank, names, strict=True)])).alias("_best"))
    return rows.join(best.orderBy("_best", story).limit(n).select(story), story, "left_semi")


def mentions(rows: DataFrame, text: Column, names: list[tuple[str, str]]) -> DataFrame:
    """`rows` with `named`: the keys of those whose pattern the text fits, in the list's order.

    Names are a short list in code, so each is an expression; nothing is joined.
    """
    return rows.withColumn("named", F.array_compact(F.array(*[F.when(text.rlike(p), key) for key, p in names])))


def split_by_mention(rows: DataFrame, title: Column, body: str, names: list[tuple[str, str]], home: Column, published: str, order: str, checks: int) -> DataFrame:
    """`rows` with `mention`: title, body, none, or pending, for candidates (an array of keys, `hits`) of each row.

    At most `checks` rows are looked up in bodies in one run, domestic ones first, then the newest; those beyond, and
    those whose body has not arrived, are pending. The limit is the feature: it bounds what one run fetches.
    """
    about = lambda text: F.array_compact(F.array(*[F.when(F.array_contains("hits", key) & text.rlike(p), key) for key, p in names]))
    in_title = F.size(about(title)) > 0
    waiting = rows.where(~F.coalesce(in_title, F.lit(False))).orderBy(home.desc(), F.col(published).desc_nulls_last(), order).limit(checks).select(F.col(order).alias("_checked"))
    looked = F.when(F.coalesce(in_title, F.lit(False)), "title").when(F.col("_checked").isNull() | F.col(body).isNull(), "pending").when(F.size(about(F.col(body))) > 0, "body").otherwise("none")
    return rows.join(waiting, F.col(order) == F.col("_checked"), "left").withColumn("mention", looked).drop("_checked")


def packed_terms(sites: DataFrame, group: list[str], order: str, site: str, terms: str, days: str, most: int = 190) -> DataFrame:
    """(group…, pack, query): search queries of at most `most` characters, sites in order, as many in each as fit.

    A group's sites are a short configured list, folded in one pass: (packs done, current pack, its query's length).
    A site that doesn't fit even alone gives a null query.
    """
    listed = sites.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(site).alias("s"))))["s"].alias("s"), F.min(terms).alias("t"), F.min(days).alias("d"))
    query = lambda t, d, x: F.concat(t, F.lit(" "), F.when(F.size(x) > 1, "(").otherwise(""), F.array_join(F.transform(x, lambda v: F.concat(F.lit("site:"), v)), " OR "), F.when(F.size(x) > 1, ")").otherwise(""), F.lit(" when:"), d.cast("string"), F.lit("d"))
    strings = "array<string>"

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["now"], F.array(s))
        fits = (F.length(query(F.col("t"), F.col("d"), more)) <= most) | (F.size(acc["now"]) == 0)
        return F.when(fits, F.struct(acc["done"].alias("done"), more.alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), F.array(s).alias("now")))

    start = F.struct(F.array().cast(f"array<{strings}>").alias("done"), F.array().cast(strings).alias("now"))
    packs = listed.select(*group, "t", "d", F.posexplode(F.aggregate("s", start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))).alias("pack", "x"))
    made = query(F.col("t"), F.col("d"), F.col("x"))
    return packs.select(*group, "pack", F.when(F.length(made) <= most, made).alias("query"))


def soonest_first(found: DataFrame, query: str, rank: str, days: Column, soon: int = 7, limit: int = 5, top: int = 2) -> DataFrame:
    """For each query: the `top` most alike that are open, then those due within `soon` days, nearest first, then the rest.

    `place` counts from 1 to `limit`; what has passed is out, unknown days are open but not soon.
    """
    open_ = found.withColumn("_days", days).where("_days IS NULL OR _days >= 0")
    nth = F.row_number().over(Window.partitionBy(query).orderBy(rank))
    tier = F.when(F.col("_nth") <= top, 0).when(F.col("_days") <= soon, 1).otherwise(2)
    ranked = open_.withColumn("_nth", nth).withColumn("_tier", tier).withColumn("_by", F.when(F.col("_tier") == 1, F.col("_days")).otherwise(F.col("_nth")))
    placed = F.row_number().over(Window.partitionBy(query).orderBy("_tier", "_by", "_nth"))
    return ranked.withColumn("place", placed).where(F.col("place") <= limit).drop("_days", "_nth", "_tier", "_by")


def chosen_attachments(files: Column, most: int = 2, preferred: str = "공고") -> Column:
    """Of an array of (name, url): those that can be read, ones with the preferred word first, else in order."""
    usable = F.filter(files, lambda f: F.lower(f["name"]).rlike(r"\.(hwpx?|pdf|docx)\b") & (F.trim(f["url"]) != ""))
    like, other = F.filter(usable, lambda f: F.contains(f["name"], F.lit(preferred))), F.filter(usable, lambda f: ~F.contains(f["name"], F.lit(preferred)))
    return F.slice(F.concat(like, other), 1, most)
