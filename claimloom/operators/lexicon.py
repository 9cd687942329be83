"""Lexicon building: merging senses, synonyms, indexes, microglosses, minting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as X


def polysemy(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("senses"))


def synonyms(entries: DataFrame, group: list[str], member: str, name: str) -> DataFrame:
    """For each member, the other names of its group (sorted, distinct); members without any are
    left out.  One set for each group replaces the self join."""
    sets = entries.groupBy(*group).agg(F.sort_array(F.collect_set(name)).alias("_all"))
    out = entries.join(sets, group).select(member, *group, F.array_except("_all", F.array(name)).alias("synonyms"))
    return out.where(F.size("synonyms") > 0)


def ordered_merge(rows: DataFrame, by: list[str], order: str, text: str, mark: str = "; ") -> DataFrame:
    """The first text, and the others joined in order."""
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_l"))
    texts = F.transform("_l", lambda x: x[text])
    return lists.select(*by, texts[0].alias("first"), F.array_join(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(1))), mark).alias("rest"), F.size(texts).alias("n"))


def postings(rows: DataFrame, key: str, lemma: Column) -> DataFrame:
    """(fragment, key) of every lemma."""
    return rows.select(F.col(key), F.explode(F.array_distinct(X.lemma_fragments(lemma))).alias("fragment"))


def holding_all(index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Rows that hold every fragment of a query: queries(query_id, fragment) distinct."""
    asked = queries.groupBy("query_id").agg(F.count_distinct("fragment").alias("_n"))
    met = queries.distinct().join(index, "fragment").groupBy("query_id", key).agg(F.count_distinct("fragment").alias("_m"))
    return met.join(asked, "query_id").where("_m = _n").select("query_id", key)


def centrality(relations: DataFrame, parent: str) -> DataFrame:
    return relations.groupBy(F.lower(F.col(parent)).alias("lemma")).agg(F.count(F.lit(1)).alias("centrality"))


def distinct_glosses(entries: DataFrame, generic: list[str] | None = None) -> DataFrame:
    """Microglosses of senses: entry_id, lemma, gloss, pos_ud, source_type to entry_id, lemma,
    microgloss, canonical_id.

    A sense takes the first words of its gloss, as many as its lemma's senses ask for.  Where senses
    of a lemma collide, each adds its two most telling other words: long, with a digit, and not shared
    with the senses it collides with.  Counts of shared words come from an aggregate; only colliding
    senses are exploded.  What still agrees takes a hash of its id."""
    senses = entries.groupBy("lemma", "pos_ud", "source_type").agg(F.count(F.lit(1)).alias("senses"))
    keyed = entries.join(senses, (entries["lemma"].eqNullSafe(senses["lemma"])) & (entries["pos_ud"].eqNullSafe(senses["pos_ud"])) & (entries["source_type"].eqNullSafe(senses["source_type"]))).select(entries["*"], "senses")
    words = X.clean_tokens(F.coalesce("gloss", F.lit("")), F.col("lemma"), STOP, generic)
    plain = keyed.select("entry_id", "lemma", "pos_ud", "source_type", words.alias("words"), X.token_budget(F.col("senses"), F.col("source_type")).alias("budget"))
    base = F.when(F.size("words") > 0, F.array_join(F.expr("slice(words, 1, budget)"), "_")).otherwise(X.canonical_part(X.fold("lemma")))
    named = plain.withColumn("base", base)
    group = ["lemma", "base"]
    clash = named.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*group)
    met = named.join(clash, group, "left_semi").select("entry_id", *group, F.posexplode("words").alias("at", "word"))
    shared = met.groupBy(*group, "word").agg((F.count(F.lit(1)) - 1).alias("others"))
    score = F.least(F.length("word") / 10, F.lit(2.0)) - 5 * F.col("others") + F.when(F.col("word").rlike("[0-9]"), 1).otherwise(0) - F.when(F.length("word") <= 3, 1).otherwise(0)
    rated = met.join(shared, [*group, "word"]).withColumn("score", score).withColumn("in_base", F.array_contains(F.split("base", "_"), F.col("word")))
    order = Window.partitionBy("entry_id").orderBy(F.desc("score"), F.desc(F.length("word")), "word")
    spare = Window.partitionBy("entry_id").orderBy("in_base", "at")
    ranked = rated.withColumn("k", F.row_number().over(order)).withColumn("s", F.row_number().over(spare))
    told = (F.col("k") <= 2) & (F.col("score") > -3) & ~F.col("in_base")
    more = ranked.groupBy("entry_id").agg(
        F.sort_array(F.collect_list(F.when(told, F.struct("k", "word")))).alias("best"),
        F.sort_array(F.collect_list(F.when(~F.col("in_base") & (F.col("s") <= 2), F.struct("s", "word")))).alias("rest"),
    )
    added = F.when(F.size("best") > 0, F.transform("best", lambda x: x["word"])).otherwise(F.transform("rest", lambda x: x["word"]))
    full = named.join(more, "entry_id", "left").withColumn("new", F.concat_ws("_", "base", F.array_join(F.coalesce(added, F.array().cast("array<string>")), "_")))
    full = full.withColumn("new", F.regexp_replace("new", "_+$", ""))
    turn = Window.partitionBy(*group, "new").orderBy("entry_id")
    out = full.withColumn("_k", F.row_number().over(turn)).withColumn("microgloss", F.when(F.col("_k") == 1, F.col("new")).otherwise(F.concat_ws("_", "base", X.short_hash(F.col("entry_id").cast("string"), 4))))
    out = out.select("entry_id", "lemma", "microgloss", "pos_ud", "source_type")
    return out.withColumn("canonical_id", X.canonical_id(X.fold("lemma"), F.col("microgloss"), F.col("pos_ud"), F.col("source_type")))


def spelling_variants(entries: DataFrame, group: list[str], lemma: str) -> DataFrame:
    """Groups of two or more lemmas that are spelling variants of one: group, key, lemmas."""
    keyed = entries.select(*group, F.lower(F.col(lemma)).alias("_l"), X.spelling_key(F.col(lemma)).alias("variant_key")).distinct()
    return keyed.groupBy(*group).agg(F.min("variant_key").alias("variant_key"), F.max("variant_key").alias("_m"), F.sort_array(F.collect_set("_l")).alias("lemmas")).where("variant_key = _m AND size(lemmas) > 1").drop("_m")


STOP = ["the", "an", "of", "in", "on", "at", "to", "for", "and", "or", "by", "with", "from", "as", "is", "are", "was", "were", "be", "that", "which", "who", "this", "it", "its", "not", "used", "any", "some", "such", "one"]


def mint(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """New entries for lemmas (lemma, pos_ud, seq) that the lexicon lacks; each once."""
    fresh = wanted.withColumn("lemma", F.lower(F.trim("lemma"))).join(entries.select(F.lower("lemma").alias("lemma"), "pos_ud").distinct(), ["lemma", "pos_ud"], "left_anti")
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("lemma", "pos_ud").orderBy("seq"))).where("_n = 1")
    return first.select("lemma", "pos_ud", F.format_string("doc.%s.unmapped.%s.docloc", X.canonical_part(X.fold("lemma")), F.lower("pos_ud")).alias("canonical_id"), X.fallback_parent(F.col("lemma"), F.col("pos_ud")).alias("parent"))


def needs_work(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("microgloss").isNull() | (F.length("microgloss") < 5) | F.col("improved_at").isNull())


# ---------------------------------------------------------------- changes to a lexicon


def updated(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` with the values of ``new`` by key; nulls in ``new`` change nothing."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys])
    joined = old.join(n, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in joined.columns else F.col(c) for c in old.columns])


def removed(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of deleted keys: name to (rows, column that refers to the key)."""
    return {n: df.join(gone.select(F.col(gone.columns[0]).alias(c)).distinct(), c, "left_anti").select(*df.columns) for n, (df, c) in tables.items()}


def migrated(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """``df`` with the columns it lacks, of a type and with a default; columns it has stay."""
    for name, (kind, default) in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


def positions(members: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The place of each member in its group, from 0."""
    return members.withColumn("position_index", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows at random, the same on every run: those of least hash of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def urgent_groups(rows: DataFrame, by: list[str], urgency: Column, least: int = 2) -> DataFrame:
    """Groups of ``least`` rows and more with how many they have and their most urgent state."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(urgency).alias("priority")).where(F.col("n") >= least)


def work_batches(entries: DataFrame, centrality: DataFrame, least: int = 2, size: int = 20) -> DataFrame:
    """Entries to improve, in batches of one lemma: lemmas of ``least`` entries and more, the most
    central first.  Columns entry_id, lemma, centrality, batch (from 0 within the lemma)."""
    keyed = entries.withColumn("_l", F.lower("lemma"))
    many = keyed.groupBy("_l").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_l")
    rank = F.row_number().over(Window.partitionBy("_l").orderBy("entry_id"))
    out = keyed.join(many, "_l").join(centrality.select(F.col("lemma").alias("_l"), "centrality"), "_l", "left")
    return out.select("entry_id", F.col("_l").alias("lemma"), F.coalesce("centrality", F.lit(0)).alias("centrality"), F.floor((rank - 1) / size).cast("int").alias("batch"))


def minted(entries: DataFrame, wanted: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """New entries for wanted senses (lemma, gloss, pos_ud, seq) that the lexicon lacks: lemma, pos_ud,
    gloss, microgloss, canonical_id, definition_tier; each lemma and part of speech once, the first."""
    w = wanted.withColumn("lemma", F.lower(F.trim("lemma")))
    lacking = w.join(entries.select(F.lower("lemma").alias("lemma")).distinct(), "lemma", "left_anti")
    first = lacking.withColumn("_n", F.row_number().over(Window.partitionBy("lemma", "pos_ud").orderBy("seq"))).where("_n = 1")
    micro = X.derived_microgloss(F.col("gloss"), F.col("lemma"), stop if stop is not None else STOP)
    out = first.withColumn("microgloss", micro).withColumn("definition_tier", F.lit("PROVISIONAL"))
    return out.withColumn("canonical_id", X.canonical_id(X.fold("lemma"), F.col("microgloss"), F.col("pos_ud"), F.lit("mint"))).select("lemma", "pos_ud", "gloss", "microgloss", "canonical_id", "definition_tier")


def missing_parents(entries: DataFrame, parents: DataFrame, most: int = 3) -> DataFrame:
    """Parents (child, parent, place) that the lexicon lacks, at most ``most`` for each child: lemma,
    whether it is an instance (it begins with a capital), children (sorted)."""
    known = entries.select(F.lower("lemma").alias("_l")).distinct()
    lacking = parents.withColumn("_l", F.lower(F.trim("parent"))).join(known, "_l", "left_anti")
    few = lacking.withColumn("_n", F.row_number().over(Window.partitionBy("child").orderBy("place", "_l"))).where(F.col("_n") <= most)
    return few.groupBy(F.col("_l").alias("lemma")).agg(F.bool_or(F.trim("parent").rlike("^[A-Z]")).alias("is_instance"), F.sort_array(F.collect_set("child")).alias("children"))


def with_fallback_parents(entries: DataFrame, relations: DataFrame) -> DataFrame:
    """IS_A relations (src_id, dst_lemma) of all entries: those given, and a guessed parent for each
    entry without one."""
    given = relations.where("rel_type = 'is_a'").select("src_id", F.lower("dst_lemma").alias("dst_lemma"), F.lit(False).alias("guessed")).distinct()
    bare = entries.select(F.col("entry_id").alias("src_id"), "lemma", "pos_ud").join(given.select("src_id").distinct(), "src_id", "left_anti")
    return given.unionByName(bare.select("src_id", X.fallback_parent(F.col("lemma"), F.col("pos_ud")).alias("dst_lemma"), F.lit(True).alias("guessed")))


def existing_parent(relations: DataFrame, child: str, parent: str, order: str) -> DataFrame:
    """The first parent of each child by ``order``, never the child itself."""
    return relations.where(F.col(child) != F.col(parent)).groupBy(child).agg(F.min_by(parent, F.struct(order, parent)).alias(parent))


def first_member_relations(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Relations between groups as relations between entries: every member of the child group to the
    first member of the parent group; no entry to itself.  ``relations``: src, rel_type, dst.
    ``members``: group, entry_id, word_index."""
    heads = members.groupBy(F.col("group").alias("dst")).agg(F.min_by("entry_id", "word_index").alias("parent_id"))
    kids = members.select(F.col("group").alias("src"), F.col("entry_id").alias("child_id"))
    return relations.join(kids, "src").join(heads, "dst").where("child_id <> parent_id").select("child_id", "rel_type", "parent_id").distinct()


def event_spokes(events: DataFrame, roles: list[str]) -> DataFrame:
    """Events (event_id, roles: map of role to a list in text) as spokes: event_id, role, place,
    surface, target_type; dates and numbers are literals, roles outside ``roles`` are left out."""
    each = events.select("event_id", F.explode("roles").alias("role", "listed")).withColumn("role", F.upper("role")).where(F.col("role").isin(roles))
    split = each.select("event_id", "role", F.posexplode(F.split("listed", ",")).alias("place", "surface")).withColumn("surface", F.trim("surface")).where("surface <> ''")
    literal = F.col("surface").rlike(r"^-?[0-9]+(\.[0-9]+)?$") | F.col("surface").rlike(r"^[0-9]{4}(-[0-9]{2}){0,2}$")
    return split.withColumn("target_type", F.when(literal, "TYPED_LITERAL").otherwise("GHOST"))


def event_groups(groups: DataFrame) -> DataFrame:
    """Groups (label, topology, members: array in order) as rows group_id, topology, position_index,
    member; a chain keeps the order, a star has its first member in the middle."""
    own = F.concat(F.lit("grp_"), F.substring(F.sha2(F.lower(F.trim("label")), 256), 1, 12))
    return groups.select(own.alias("group_id"), F.when(F.upper("topology") == "CHAIN", "CHAIN").otherwise("STAR").alias("topology"), F.posexplode("members").alias("position_index", "member"))


def event_links(links: DataFrame, keys: DataFrame, allowed: list[str]) -> DataFrame:
    """Links by event keys as links by ids; a link with an unknown end or type is left out.  ``links``:
    source, link_type, target.  ``keys``: key, synapse_id."""
    a, b = keys.select(F.col("key").alias("source"), F.col("synapse_id").alias("source_id")), keys.select(F.col("key").alias("target"), F.col("synapse_id").alias("target_id"))
    kind = F.upper(F.trim("link_type"))
    return links.join(a, "source").join(b, "target").where(kind.isin(allowed)).select("source_id", kind.alias("link_type"), "target_id").distinct()


def improved(entries: DataFrame, relations: DataFrame, results: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Entries and relations after a batch of results (entry_id, gloss, microgloss, parents): texts that
    a result gives take the place of the old ones, its parents replace the entry's is_a relations, and the
    entry counts as improved."""
    done = results.select("entry_id", F.nullif(F.trim("gloss"), F.lit("")).alias("gloss"), F.nullif(F.trim("microgloss"), F.lit("")).alias("microgloss"), at.alias("improved_at"))
    fresh = updated(entries, done, ["entry_id"])
    told = results.where(F.size("parents") > 0)
    kept = relations.join(told.select(F.col("entry_id").alias("src_id"), F.lit("is_a").alias("rel_type")).distinct(), ["src_id", "rel_type"], "left_anti")
    new = told.select(F.col("entry_id").alias("src_id"), F.lit("is_a").alias("rel_type"), F.explode(F.array_distinct("parents")).alias("dst_lemma"))
    return fresh, kept.select("src_id", "rel_type", "dst_lemma").unionByName(new)


def duplicate_aliases(aliases: DataFrame, entries: DataFrame) -> DataFrame:
    """Aliases of one word and more than two characters that differ from their lemma, with how many
    entries share them."""
    pairs = aliases.join(entries.select("entry_id", F.lower("lemma").alias("_l")), "entry_id").where((F.col("alias") != F.col("_l")) & ~F.col("alias").like("% %") & (F.length("alias") > 2))
    return pairs.groupBy("alias").agg(F.count_distinct("entry_id").alias("entries"))
