"""Text search over whole document tables for whole tables of queries, and ingredient lookup."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrec.functions import text as tx
from quillrec.operators.topk import first_per_key, top_k

# Field boosts of the weighted search and the usual BM25 constants.
FIELD_BOOSTS = {
    "title": 4.0,
    "clean_title": 3.0,
    "description": 2.0,
    "ingredients_text": 2.0,
    "tags_text": 1.0,
    "author_name": 1.0,
}
K1, B = 1.2, 0.75
DIGITS = 6
GRAM = 3
BATCH = 1_000


def substring_search(queries: DataFrame, docs: DataFrame, key: str, text: Column, limit: int = 20) -> DataFrame:
    """(query, key): first `limit` documents (by key) whose lower-cased text contains the query.

    Up to BATCH distinct queries are tested inside each document row, so texts are read once and
    never copied per query. More queries meet the documents through a shared three-letter piece.
    """
    distinct = queries.select(F.lower("query").alias("query")).where(F.col("query") != "").distinct()
    body = docs.select(key, F.lower(text).alias("_text"))
    if distinct.limit(BATCH + 1).count() <= BATCH:
        packed = distinct.agg(F.collect_list("query")).scalar()
        inside = F.filter("_queries", lambda q: F.contains(F.col("_text"), q))
        found = body.withColumn("_queries", packed).select(key, F.explode(inside).alias("query"))
    else:
        short = F.length("query") < GRAM
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("_text") - GRAM + 1, F.lit(1))),
            lambda i: F.substr(F.col("_text"), i, F.lit(GRAM)),
        )
        # A query shorter than a piece matches by its own length's pieces.
        small = F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.lit(GRAM - 1)),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1))),
                    lambda i: F.substr(F.col("_text"), i, n),
                ),
            )
        )
        pieces = body.select(key, "_text", F.explode(F.array_distinct(F.concat(grams, small))).alias("_piece"))
        keyed = distinct.withColumn(
            "_piece", F.when(short, F.col("query")).otherwise(F.substring("query", 1, GRAM))
        )
        found = pieces.join(keyed, "_piece").where(F.contains("_text", F.col("query"))).select(key, "query").distinct()
    return top_k(found, ["query"], [F.asc(key)], limit).drop("rn")


def deletions(term: Column, edits: int) -> Column:
    """The term and every form with up to `edits` (0-2) characters removed."""

    def shorter(word: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))),
            lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)),
        )

    forms = [F.array(term)]
    for _ in range(edits):
        forms.append(F.flatten(F.transform(forms[-1], shorter)))
    return F.array_distinct(F.concat(*forms))


def allowed_edits(term: Column) -> Column:
    """Edits tolerated by length: none under 3 letters, one up to 5, two beyond."""
    return F.when(F.length(term) < 3, 0).when(F.length(term) <= 5, 1).otherwise(2)


def similar_terms(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(term, word, weight): dictionary words within the tolerated edit distance of each query term.

    Words at distance d share a form with at most d letters removed from each, so candidates come
    from an equi-join on those forms and only they are measured.
    """
    limit = allowed_edits(F.col("term"))
    forms = terms.select("term", limit.alias("limit"), F.explode(deletions(F.col("term"), 2)).alias("form"))
    words = dictionary.select("word", F.explode(deletions(F.col("word"), 2)).alias("form"))
    measured = (
        forms.join(words, "form")
        .select("term", "word", "limit")
        .distinct()
        .withColumn("edits", F.levenshtein("term", "word"))
    )
    weight = 1 - F.col("edits") / F.least(F.length("term"), F.length("word"))
    return measured.where(F.col("edits") <= F.col("limit")).select("term", "word", weight.alias("weight"))


def weighted_search(
    queries: DataFrame,
    docs: DataFrame,
    key: str,
    boosts: Mapping[str, float] = FIELD_BOOSTS,
    limit: int = 20,
    fuzzy: bool = True,
) -> DataFrame:
    """(query, key, score): best documents by the best field's boosted BM25 sum over the query terms.

    `docs` holds the key and one text column per field. Each query term counts once per field, by
    its best matching word; a fuzzy match is scaled by its closeness.
    """
    fields = {f: b for f, b in boosts.items() if f in docs.columns}
    boost = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    stacked = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("")).alias("text")) for f in fields])
    words = tx.tokens(F.col("text"))
    long = docs.select(key, F.inline(stacked)).select(key, "field", words.alias("words"), F.size(words).alias("len"))
    sizes = long.where(F.col("len") > 0).groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len")
    )
    postings = long.select(key, "field", "len", F.explode("words").alias("word")).groupBy(key, "field", "word", "len").agg(
        F.count(F.lit(1)).alias("tf")
    )
    frequency = postings.groupBy("field", "word").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("query").distinct().select(
        "query", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term")
    )
    terms = asked.select("term").distinct()
    dictionary = postings.select("word").distinct()
    exact = terms.select("term", F.col("term").alias("word"), F.lit(1.0).alias("weight"))
    matches = similar_terms(terms, dictionary) if fuzzy else exact
    wanted = matches.join(frequency, "word").join(F.broadcast(sizes), "field")  # sizes: one row per field
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = wanted.select("term", "word", "field", (F.col("weight") * idf).alias("w"), "avg_len")
    norm = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    per_term = (
        wanted.join(postings.hint("merge"), ["word", "field"])  # the planner takes exploded words for a small table
        .groupBy("term", "field", key)
        .agg(F.max(F.col("w") * norm * F.try_element_at(boost, F.col("field"))).alias("s"))
    )
    per_field = asked.join(per_term, "term").groupBy("query", key, "field").agg(F.round(F.sum("s"), DIGITS).alias("s"))
    best = per_field.groupBy("query", key).agg(F.max("s").alias("score"))
    return top_k(best, ["query"], [F.desc("score"), F.asc(key)], limit).drop("rn")


# --- search documents ------------------------------------------------------------------------------


def json_list_text(text: Column) -> Column:
    """JSON list to space-joined text; other text stays as it is; missing gives ''."""
    is_list = F.startswith(F.trim(text), F.lit("["))
    joined = F.array_join(F.from_json(text, "array<string>"), " ")
    return F.coalesce(F.when(is_list, joined), text, F.lit(""))


def search_documents(profile: DataFrame, detail: DataFrame) -> DataFrame:
    """One search row per profiled item: detail fields win, blanks fall back.

    title -> name -> clean_title -> 'Recipe <id>'; tag list -> profile tag text.
    """
    blank = tx.blank_to_null
    overlap = [c for c in detail.columns if c != "item_id" and c in profile.columns]
    joined = profile.join(detail.withColumnsRenamed({c: f"_d_{c}" for c in overlap}), "item_id", "left")
    for c in overlap:
        joined = joined.withColumn(c, F.coalesce(f"_d_{c}", c)).drop(f"_d_{c}")
    have = set(joined.columns)
    field = lambda c: blank(F.col(c)) if c in have else F.lit(None).cast("string")
    listed = lambda c: blank(json_list_text(F.col(c))) if c in have else F.lit(None).cast("string")
    title = F.coalesce(
        field("title"), field("name"), field("clean_title"), F.concat(F.lit("Recipe "), F.col("item_id").cast("string"))
    )
    return joined.select(
        "item_id",
        title.alias("title"),
        F.coalesce(field("clean_title"), title).alias("clean_title"),
        F.coalesce(field("description"), F.lit("")).alias("description"),
        F.coalesce(listed("tags_json"), field("tag_text"), F.lit("")).alias("tags_text"),
        F.coalesce(listed("ingredients_json"), F.lit("")).alias("ingredients_text"),
        F.coalesce(field("author_name"), F.lit("")).alias("author_name"),
    )


# --- ingredient dictionary ---------------------------------------------------------------------------


def ingredient_catalog(dictionary: DataFrame, phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(name, label, n): display label per ingredient; names without one are dropped.

    A known phrase gives its label; else the given label when it holds no Latin letters or slashes;
    else the labels of all words in order (repeats in a row once), if every word is known.
    `phrases`, `words`: (name, label) tables.
    """
    parts = F.filter(
        F.split("name", r"[\s_/&(),'-]+"), lambda w: (w != "") & ~w.isin("and", "of", "the")
    )
    exploded = dictionary.select("name").distinct().select("name", F.posexplode(parts).alias("pos", "word"))
    known = exploded.join(words.select(F.col("name").alias("word"), F.col("label").alias("word_label")), "word", "left")
    built = known.groupBy("name").agg(
        F.max(F.col("word_label").isNull()).alias("gap"),
        F.array_sort(F.collect_list(F.struct("pos", "word_label"))).alias("m"),
    )
    labels = F.transform("m", lambda x: x["word_label"])
    once = F.filter(labels, lambda x, i: (i == 0) | (x != F.get(labels, i - 1)))
    composed = built.where(~F.col("gap")).select("name", F.array_join(once, "").alias("composed"))
    joined = dictionary.join(phrases.select("name", F.col("label").alias("phrase")), "name", "left").join(
        composed, "name", "left"
    )
    given = F.when((F.col("raw_label") != "") & ~F.rlike("raw_label", F.lit("[A-Za-z/]")), F.col("raw_label"))
    label = tx.blank_to_null(F.coalesce("phrase", given, "composed"))
    return joined.select("name", label.alias("label"), "n").where((F.col("name") != "") & label.isNotNull())


def map_terms(terms: DataFrame, catalog: DataFrame) -> DataFrame:
    """(term, name): ingredient name behind a label or name; unknown terms stay themselves."""
    by_label = catalog.select(F.lower("label").alias("alias"), "name", "n", "label")
    by_name = catalog.select(F.col("name").alias("alias"), "name", "n", "label")
    order = [F.desc("n"), F.asc("label"), F.asc("name")]
    table = first_per_key(by_label.unionByName(by_name), ["alias"], order).select("alias", F.col("name").alias("found"))
    cleaned = terms.select("term", F.lower(F.trim("term")).alias("alias")).where(F.col("alias") != "")
    return cleaned.join(table, "alias", "left").select("term", F.coalesce("found", "alias").alias("name"))


def ingredient_matches(queries: DataFrame, catalog: DataFrame, limit: int = 30) -> DataFrame:
    """(query, name, label, position): autocomplete; the best entry per label.

    Order: label equal, label prefix, label part, name equal, name prefix, name part; then shorter
    label, higher count, shorter name, label. A blank query lists the most frequent entries.
    """
    asked = queries.select(F.lower(F.trim("query")).alias("query")).distinct()
    lengths = asked.agg(F.collect_set(F.length("query"))).scalar()
    label, name = F.lower("label"), F.col("name")

    def pieces(text: Column) -> Column:
        return F.flatten(
            F.transform(
                F.filter("_sizes", lambda s: (s > 0) & (s <= F.length(text))),
                lambda size: F.transform(
                    F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)
                ),
            )
        )

    parts = F.array_distinct(F.concat(F.array(F.lit("")), pieces(label), pieces(name)))
    matched = (
        catalog.withColumn("_sizes", lengths)
        .select("name", "label", "n", F.explode(parts).alias("query"))
        .join(asked, "query")
    )
    q = F.col("query")
    ranks = [
        q == "",
        label == q,
        F.startswith(label, q),
        F.contains(label, q),
        name == q,
        F.startswith(name, q),
    ]
    rank = reduce(lambda acc, pair: acc.when(pair[1], pair[0]), list(enumerate(ranks))[1:], F.when(ranks[0], 0)).otherwise(6)
    blank = q == ""
    order = [
        rank.asc(),
        F.when(blank, 0).otherwise(F.length(label)).asc(),
        F.desc("n"),
        F.when(blank, 0).otherwise(F.length(name)).asc(),
        label.asc(),
        name.asc(),
    ]
    best = first_per_key(matched.withColumn("_label", label), ["query", "_label"], order)
    return top_k(best, ["query"], order, limit, "position").select("query", "name", "label", "n", "position")
