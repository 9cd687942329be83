"""Lexical sources: WordNet XML, Wiktionary JSON lines, abstracts in Turtle; graph exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.text import escape_cypher, escape_triple

# Raw WordNet relations, their bucket, and whether source and target swap.
WORDNET_RELATIONS = {
    "hypernym": ("is_a", True), "hyponym": ("is_a", False), "similar": ("antonym_of", False), "mero_part": ("has_part", True),
    "holo_part": ("has_part", False), "mero_substance": ("has_part", True), "holo_substance": ("has_part", False),
    "mero_member": ("has_member", True), "holo_member": ("has_member", False), "exemplifies": ("has_instance", False),
    "is_exemplified_by": ("has_instance", True), "attribute": ("derivation", False), "causes": ("derivation", False),
    "is_caused_by": ("derivation", True), "entails": ("derivation", False), "is_entailed_by": ("derivation", True),
    "antonym": ("antonym_of", False), "derivation": ("derivation", False), "pertainym": ("derivation", False),
    "derived_from_adjective": ("derivation", False), "also": ("derivation", False), "verb_group": ("derivation", False),
    "domain_topic": ("is_a", False), "domain_region": ("is_a", False), "has_domain_topic": ("has_member", False),
    "has_domain_region": ("has_member", False), "member_of_domain_topic": ("has_member", False),
    "member_of_domain_region": ("has_member", False), "member_of_domain_usage": ("has_member", False), "subevent": ("is_a", False),
    "is_subevent_of": ("is_a", True),
}

_SYNSET = "_id string, _partOfSpeech string, Definition array<string>, Example array<string>, SynsetRelation array<struct<_relType:string,_target:string>>"
_ENTRY = "_id string, Lemma struct<_writtenForm:string,_partOfSpeech:string>, Sense array<struct<_id:string,_synset:string>>"


def wordnet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(synsets, entries, relations) of a lexical XML file, read by row tag."""
    raw = spark.read.format("xml").option("rowTag", "Synset").schema(_SYNSET).load(path)
    synsets = raw.select(F.col("_id").alias("synset_id"), F.col("_partOfSpeech").alias("pos"), F.array_join("Definition", " ").alias("gloss"), F.col("Example").alias("examples"))
    words = spark.read.format("xml").option("rowTag", "LexicalEntry").schema(_ENTRY).load(path)
    senses = words.select(F.col("_id").alias("word"), F.col("Lemma._writtenForm").alias("lemma"), F.posexplode("Sense").alias("place", "s")).select("word", "lemma", "place", F.col("s._id").alias("sense_id"), F.col("s._synset").alias("synset_id"))
    order = Window.partitionBy("synset_id").orderBy("word", "place")
    entries = senses.join(synsets, "synset_id").withColumn("word_index", F.row_number().over(order))
    kinds = spark.createDataFrame([(k, b, i) for k, (b, i) in WORDNET_RELATIONS.items()], "raw string, rel_type string, swap boolean")
    links = raw.select(F.col("_id").alias("a"), F.explode("SynsetRelation").alias("r")).select("a", F.col("r._relType").alias("raw"), F.col("r._target").alias("b")).join(F.broadcast(kinds), "raw")
    pairs = links.select(F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("src"), "rel_type", F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("dst"))
    known = synsets.select("synset_id")
    relations = pairs.distinct().join(known.withColumnRenamed("synset_id", "src"), "src", "left_semi").join(known.withColumnRenamed("synset_id", "dst"), "dst", "left_semi").select("src", "rel_type", "dst")
    return synsets, entries, relations


_WORD = "word string, lemma string, pos string, lang_code string, redirect string, etymology_number int, senses array<struct<glosses:array<string>,raw_glosses:array<string>,tags:array<string>,categories:array<string>,examples:array<struct<text:string>>,synonyms:array<struct<word:string>>>>, _bad string"


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many lines of a file of JSON lines cannot be read, of how many."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    return raw.agg(F.count_if(F.try_parse_json("value").isNull()).alias("bad"), F.count(F.lit(1)).alias("total"))


def wiktionary(spark: SparkSession, path: str, lang: str | None = None, redirects: bool = False) -> DataFrame:
    """One row per sense; a word without senses keeps one empty sense; bad lines are skipped (and
    counted by ``bad_lines``)."""
    raw = spark.read.schema(_WORD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = raw.where("_bad IS NULL").withColumn("word", F.coalesce("word", "lemma")).where("word IS NOT NULL")
    if lang:
        rows = rows.where(F.col("lang_code") == lang)
    if not redirects:
        rows = rows.where("redirect IS NULL")
    senses = rows.select("word", "pos", "lang_code", "etymology_number", F.posexplode_outer("senses").alias("place", "s"))
    plain = F.transform(F.coalesce("s.categories", F.array().cast("array<string>")), lambda c: F.regexp_replace(c, "^[a-z]{2,3}:", ""))
    return senses.select("word", "pos", "lang_code", "etymology_number", F.coalesce("place", F.lit(0)).alias("sense_index"), F.array_join("s.glosses", " ").alias("gloss"), F.array_distinct(plain).alias("categories"), F.coalesce("s.tags", F.array().cast("array<string>")).alias("tags"))


def abstracts(spark: SparkSession, path: str) -> DataFrame:
    """(title, abstract) of English comments in Turtle; the last line of a title wins."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))
    found = lines.select("n", F.regexp_extract("value", r"^<[^>]*/resource/([^>]+)>", 1).alias("raw"), F.regexp_extract("value", r'rdf-schema#comment>\s+"((?:[^"\\]|\\.)*)"@en', 1).alias("abstract")).where("raw <> '' AND abstract <> ''")
    return found.groupBy(clean_title(F.col("raw")).alias("title")).agg(F.max_by("abstract", "n").alias("abstract"))


def unique_titles(rows: DataFrame, order: str) -> DataFrame:
    """Articles (title, abstract, order) under clean titles, the first of each title."""
    named = rows.withColumn("title", F.trim(clean_title(F.col("title")))).where("title <> ''")
    return named.withColumn("_n", F.row_number().over(Window.partitionBy("title").orderBy(order))).where("_n = 1").drop("_n")


def clean_title(raw: Column) -> Column:
    """Underscores to blanks, percent signs decoded; a plus sign stays itself."""
    return F.try_url_decode(F.replace(F.translate(raw, "_", " "), F.lit("+"), F.lit("%2B")))


# Tags of parts of speech by source, and their universal tag.
WORDNET_POS = {"n": "NOUN", "v": "VERB", "a": "ADJ", "s": "ADJ", "r": "ADV"}
WIKTIONARY_POS = {
    "noun": "NOUN", "verb": "VERB", "adj": "ADJ", "adv": "ADV", "name": "PROPN", "pron": "PRON", "prep": "ADP", "postp": "ADP", "conj": "CCONJ",
    "det": "DET", "article": "DET", "num": "NUM", "intj": "INTJ", "particle": "PART", "punct": "PUNCT", "symbol": "SYM", "phrase": "X",
    "proverb": "X", "prefix": "X", "suffix": "X",
}


def normal_pos(pos: Column, source: str = "wiktionary") -> Column:
    """Universal tags for the tags of a source; lists such as "noun, verb" become lists of tags, each
    once; what is unknown is X."""
    names = WORDNET_POS if source == "wordnet" else WIKTIONARY_POS | WORDNET_POS
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    tags = F.transform(F.split(F.lower(F.trim(pos)), r"\s*,\s*"), lambda p: F.coalesce(table[p], F.lit("X")))
    return F.array_join(F.array_distinct(tags), ",")


def plain_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each text file as one document, named by its file without the ending."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"))


def rows_as_claims(rows: DataFrame, hub: str, roles: dict[str, str], key: list[str]) -> DataFrame:
    """Each row of a table as one claim: synapse_id, verb_lemma, spokes (place, role, surface) by a map
    of roles to columns; empty cells make no spoke, rows without spokes no claim."""
    spoke = lambda i, r, c: F.when(F.trim(F.col(c).cast("string")) != "", F.struct(F.lit(i).alias("place"), F.lit(r).alias("role"), F.trim(F.col(c).cast("string")).alias("surface")))
    own = F.concat(F.lit("syn_"), F.substring(F.sha2(F.concat_ws(":", F.lit(hub), *key), 256), 1, 12))
    spokes = F.array_compact(F.array(*[spoke(i, r, c) for i, (r, c) in enumerate(roles.items())]))
    return rows.select(own.alias("synapse_id"), F.lit(hub).alias("verb_lemma"), spokes.alias("spokes")).where(F.size("spokes") > 0)


def table_file(spark: SparkSession, path: str, mark: str = ",") -> DataFrame:
    """A CSV or TSV file with a header, all cells as text."""
    return spark.read.option("header", "true").option("sep", mark).option("multiLine", "true").csv(path)


def closed_list(spark: SparkSession, path: str) -> list[str]:
    """The words of a list file, without comments and blank lines; a list that people keep by hand."""
    rows = spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("w")).where("w <> ''")
    return sorted({r["w"] for r in rows.collect()})


def store(spark: SparkSession, folder: str, tables: list[str]) -> dict[str, DataFrame]:
    """Tables of a store, Parquet below one folder; two stores are two calls."""
    return {t: spark.read.parquet(f"{folder}/{t}") for t in tables}


def empty_store(spark: SparkSession, folder: str, schemas: dict, seed: dict[str, list] | None = None) -> None:
    """Writes each table of a new store with its columns, and its first rows if given."""
    for name, schema in schemas.items():
        spark.createDataFrame((seed or {}).get(name, []), schema).write.mode("errorifexists").parquet(f"{folder}/{name}")


# ---------------------------------------------------------------- exports


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    """MERGE statements from (id, label, name, priority); the first definition of an id wins."""
    first = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("priority"))).where("_n = 1")
    return first.select(F.concat(F.lit("MERGE (n:"), F.col("label"), F.lit(" {id: '"), escape_cypher(F.col("id")), F.lit("'}) SET n.name = '"), escape_cypher(F.coalesce("name", F.lit(""))), F.lit("';")).alias("value"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    """MATCH and MERGE statements from (src, type, dst); edges without a target are dropped."""
    e = edges.where("dst IS NOT NULL").distinct()
    return e.select(F.concat(F.lit("MATCH (a {id: '"), escape_cypher(F.col("src")), F.lit("'}), (b {id: '"), escape_cypher(F.col("dst")), F.lit("'}) MERGE (a)-[:"), F.col("type"), F.lit("]->(b);")).alias("value"))


def iri(identifier: Column) -> Column:
    return F.concat(F.lit("syn:"), F.replace(identifier, F.lit("."), F.lit("_")))


def triples(edges: DataFrame) -> DataFrame:
    """Turtle lines from (src, predicate, dst, literal)."""
    target = F.when(F.col("literal").isNotNull(), F.concat(F.lit('"'), escape_triple(F.col("literal")), F.lit('"'))).otherwise(iri(F.col("dst")))
    return edges.where("dst IS NOT NULL OR literal IS NOT NULL").select(F.concat_ws(" ", iri(F.col("src")), F.col("predicate"), target, F.lit(".")).alias("value")).distinct()


def node_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Nodes of a graph from several tables (id, label, name), the first table's definition of an id
    first: id, label, name, priority."""
    out = None
    for i, df in enumerate(parts.values()):
        one = df.where("id IS NOT NULL").select("id", "label", "name", F.lit(i).alias("priority"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.min_by(F.struct("label", "name", "priority"), F.struct("priority", "label", "name")).alias("v")).select("id", "v.*")


def edge_union(parts: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """Edges of a graph from several tables, each once, between known nodes: src, type, dst.  A part
    has src and dst, and a type of its own or else the part's name."""
    out = None
    for name, df in parts.items():
        one = df.select("src", (F.col("type") if "type" in df.columns else F.lit(name)).alias("type"), "dst")
        out = one if out is None else out.unionByName(one)
    ids = nodes.select("id").distinct()
    return out.where("dst IS NOT NULL").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "type", "dst")


def edge_target(kind: Column, synapse: Column, literal: Column, cid: Column, entity: Column) -> Column:
    """The node that a spoke points to: a claim, a literal, else the id in the lexicon or the entity."""
    return F.when(kind == "SYNAPSE", synapse).when(kind == "TYPED_LITERAL", F.concat(F.lit("lit."), literal)).otherwise(F.coalesce(cid, entity))


# Classes of an upper ontology for kinds of entities.
UPPER_CLASSES = {
    "person": "BFO_0000040", "org": "BFO_0000027", "gpe": "BFO_0000029", "loc": "BFO_0000029", "fac": "BFO_0000029", "event": "BFO_0000015",
    "product": "BFO_0000030", "work_of_art": "BFO_0000031", "language": "BFO_0000031", "literal": "BFO_0000031",
}


def upper_class(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in UPPER_CLASSES.items() for x in kv])[F.lower(kind)], F.lit("BFO_0000001"))


def sparql_insert(lines: DataFrame, size: int = 1000) -> DataFrame:
    """Turtle lines (value) as INSERT DATA statements of about ``size`` triples each."""
    n = lines.withColumn("_b", F.pmod(F.xxhash64("value"), F.greatest(F.ceil(F.lit(lines.count()) / size), F.lit(1)).cast("long")))
    return n.groupBy("_b").agg(F.concat(F.lit("INSERT DATA {\n"), F.array_join(F.sort_array(F.collect_list("value")), "\n"), F.lit("\n}")).alias("value")).select("value")


def knowledge_pack(rows: DataFrame, key: str) -> DataFrame:
    """Canonical JSON of each row and its content hash."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.select(key, text.alias("payload")).withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("payload", 256)))


def binary_edges(claims: DataFrame) -> DataFrame:
    """Claims of at most three roles as pairs of fillers; larger claims stay n-ary.  ``claims``:
    synapse_id, verb, spokes (array of struct(role, target_id))."""
    small = claims.where(F.size("spokes") <= 3).select("synapse_id", "verb", F.posexplode("spokes").alias("i", "a"), "spokes")
    return small.select("synapse_id", "verb", F.col("a.target_id").alias("src"), F.explode(F.expr("slice(spokes, i + 2, size(spokes))")).alias("b")).select("synapse_id", "src", "verb", F.col("b.target_id").alias("dst"))


def profile_files(spark: SparkSession, folder: str, last: DataFrame | None = None) -> DataFrame:
    """Files of a folder with size and content hash; with ``last``, only new or changed ones."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.sha2("content", 256).alias("content_hash"))
    return now if last is None else now.join(last.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
