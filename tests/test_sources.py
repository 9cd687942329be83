import base64
import zlib

import pytest
from pyspark.sql import functions as F

from claimloom.sources import blocks, lexical, rskv

TEXT = "﻿#SET: people\r\n#SCHEMA: id:int:pk, name:str, score:float\r\n#META: owner: me\r\nid: 1\r\nname: Ann: B  \r\nscore: 1.5\r\n---ROW---\r\n---ROW---\r\nid: x\nname: \n---ROW---\nid: 3\nname: \\N\nnote: a\\nb \\\\n \\# \\---ROW--- \\t\n#ENDSET\nnoise\n#SET: empty\n#ENDSET\n#SET: people\nid: 4\n"


def test_records_and_states():
    rows = list(rskv.records(TEXT.split("\n")))
    assert [r[0:2] for r in rows] == [("people", 0), ("people", 1), ("people", 2), ("people", 3)]
    assert rows[0][2] == {"id": "int", "name": "str", "score": "float"} and rows[0][3] == {"owner": "me"}
    assert rows[0][4] == {"id": "1", "name": "Ann: B  ", "score": "1.5"}
    assert rows[1][4]["name"] == "" and "score" not in rows[1][4]
    assert rows[2][4]["name"] is None and rows[2][4]["note"] == "a\nb \\n # ---ROW--- \\t"


def test_strict():
    for bad in ("#SET: s\na: \\t", "#SET: s\na: 1\na: 2", "#SET: s\n#ODD\n"):
        with pytest.raises(rskv.RskvError):
            list(rskv.records(bad.split("\n"), strict=True))


def test_source_types_and_round_trip(spark, tmp_path):
    f = tmp_path / "a.rskv"
    f.write_text(TEXT, encoding="utf-8")
    rskv.register(spark)
    df = spark.read.format("rskv").option("paths", str(f)).load()
    got = {r.position: r for r in rskv.typed(df, {"id": "int", "score": "float"}).collect()}
    assert (got[0].id, got[0].score) == (1, 1.5) and got[1].id is None and got[1].record["id"] == "x"
    rows = [(1, "a\\n#b\n---ROW---", 1.5), (2, None, None), (3, "", -2.0), (4, "#x: y", 0.0)]
    out = spark.createDataFrame(rows, "id long, name string, score double")
    rskv.write(out, "t", str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True).select(F.explode(rskv.parse_column(F.col("value"))).alias("r")).select("r.*")
    again = rskv.typed(back, {"id": "int", "name": "str", "score": "float"}).select("id", "name", "score").collect()
    assert sorted(map(tuple, again), key=lambda r: r[0]) == rows


def test_blocks(spark):
    text = "junk: 1\n:::entity\nname: Ann\n  Smith\nage: 3\nodd line\n:::\n:::x\nnever: ends"
    assert blocks.parse_blocks(text) == [{"_kind": "entity", "name": "Ann\nSmith", "age": "3"}]
    assert blocks.parse_blocks(None) == []
    df = spark.createDataFrame([(text, "a\nb", None)], "t string, v string, n string")
    made = df.select(blocks.block_text("k", {"v": F.col("v"), "n": F.col("n")}).alias("b"), blocks.blocks("t").alias("p"), blocks.answer(F.lit("x <ANSWER> y </ANSWER>")).alias("a")).first()
    assert made.b == ":::k\nv: a\n  b\n:::\n" and made.p[0]["name"] == "Ann\nSmith" and made.a == "y"


def test_wordnet_wiktionary_abstracts(spark, tmp_path):
    (tmp_path / "w.xml").write_text(
        '<LexicalResource><Lexicon><LexicalEntry id="e1"><Lemma writtenForm="dog" partOfSpeech="n"/><Sense id="s1" synset="y1"/><Sense id="s2" synset="none"/></LexicalEntry>'
        '<LexicalEntry id="e2"><Lemma writtenForm="hound" partOfSpeech="n"/><Sense id="s3" synset="y1"/></LexicalEntry>'
        '<LexicalEntry id="e3"><Lemma writtenForm="animal" partOfSpeech="n"/><Sense id="s4" synset="y2"/></LexicalEntry>'
        '<Synset id="y1" partOfSpeech="n"><Definition>a pet</Definition><SynsetRelation relType="hypernym" target="y2"/><SynsetRelation relType="odd" target="y2"/><SynsetRelation relType="hyponym" target="gone"/></Synset>'
        '<Synset id="y2" partOfSpeech="n"><Definition>a being</Definition><Definition>alive</Definition></Synset></Lexicon></LexicalResource>'
    )
    synsets, entries, relations = lexical.wordnet(spark, str(tmp_path / "w.xml"))
    assert {r.synset_id: r.gloss for r in synsets.collect()} == {"y1": "a pet", "y2": "a being alive"}
    assert sorted((r.lemma, r.word_index) for r in entries.collect()) == [("animal", 1), ("dog", 1), ("hound", 2)]
    assert [tuple(r) for r in relations.collect()] == [("y2", "is_a", "y1")]
    (tmp_path / "k.jsonl").write_text('{"word":"bank","lang_code":"en","senses":[{"glosses":["a","b"],"categories":["en:X","X"]},{"glosses":["c"]}]}\n{bad\n{"lemma":"none","lang_code":"en"}\n{"word":"r","redirect":"x","lang_code":"en"}\n{"word":"de","lang_code":"de"}\n')
    got = sorted((r.word, r.sense_index, r.gloss, r.categories) for r in lexical.wiktionary(spark, str(tmp_path / "k.jsonl"), "en").collect())
    assert got == [("bank", 0, "a b", ["X"]), ("bank", 1, "c", []), ("none", 0, None, [])]
    (tmp_path / "a.ttl").write_text('<http://d/resource/C++_x> <http://www.w3.org/2000/01/rdf-schema#comment> "old"@en .\n<http://d/resource/C++_x> <http://www.w3.org/2000/01/rdf-schema#comment> "new \\"q\\""@en .\n<http://d/resource/Y> <http://www.w3.org/2000/01/rdf-schema#comment> "nein"@de .\n')
    assert [(r.title, r.abstract) for r in lexical.abstracts(spark, str(tmp_path / "a.ttl")).collect()] == [("C++ x", 'new \\"q\\"')]


def test_exports(spark):
    nodes = spark.createDataFrame([("a", "Entry", "it's", 2), ("a", "Entry", "first", 1)], "id string, label string, name string, priority int")
    assert [r.value for r in lexical.cypher_nodes(nodes).collect()] == ["MERGE (n:Entry {id: 'a'}) SET n.name = 'first';"]
    edges = spark.createDataFrame([("a", "IS_A", "b"), ("a", "IS_A", None)], "src string, type string, dst string")
    assert [r.value for r in lexical.cypher_edges(edges).collect()] == ["MATCH (a {id: 'a'}), (b {id: 'b'}) MERGE (a)-[:IS_A]->(b);"]
    t = spark.createDataFrame([("en.a", "syn:p", None, 'x"y'), ("en.a", "syn:q", "en.b", None)], "src string, predicate string, dst string, literal string")
    assert sorted(r.value for r in lexical.triples(t).collect()) == ['syn:en_a syn:p "x\\"y" .', "syn:en_a syn:q syn:en_b ."]
    packs = lexical.knowledge_pack(t, "src").collect()
    assert all(p.content_hash.startswith("sha256:") and '"dst"' in p.payload for p in packs)


def test_more_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert [tuple(r) for r in lexical.plain_documents(spark, str(tmp_path / "a.txt")).collect()] == [("a", "one\ntwo")]
    (tmp_path / "l.list").write_text("# verbs\nSay  # plain\n\nclaim\nsay\n")
    assert lexical.closed_list(spark, str(tmp_path / "l.list")) == ["claim", "say"]
    (tmp_path / "t.tsv").write_text("who\twhat\nAnn\tbooks\nBob\t\n")
    rows = lexical.table_file(spark, str(tmp_path / "t.tsv"), "\t")
    claims = lexical.rows_as_claims(rows, "buy", {"HAS_AGENT": "who", "HAS_THEME": "what"}, ["who"]).collect()
    assert sorted([[(s.role, s.surface) for s in c.spokes] for c in claims]) == [[("HAS_AGENT", "Ann"), ("HAS_THEME", "books")], [("HAS_AGENT", "Bob")]]
    (tmp_path / "k.jsonl").write_text('{"a": 1}\n{bad\n\n{"b": 2}\n')
    assert tuple(lexical.bad_lines(spark, str(tmp_path / "k.jsonl")).first()) == (1, 3)
    titles = spark.createDataFrame([("C%2B%2B_x", "first", 1), ("C++_x", "second", 2), ("_", "none", 3)], "title string, abstract string, n int")
    assert [(r.title, r.abstract) for r in lexical.unique_titles(titles, "n").collect()] == [("C++ x", "first")]
    lexical.empty_store(spark, str(tmp_path / "s"), {"entry": "id int, lemma string", "link": "a int"}, {"entry": [(1, "seed")]})
    made = lexical.store(spark, str(tmp_path / "s"), ["entry", "link"])
    assert made["entry"].count() == 1 and made["link"].columns == ["a"] and made["link"].count() == 0
    pos = spark.createDataFrame([("noun, v",), ("S",), ("odd",)], "p string")
    assert [tuple(r) for r in pos.select(lexical.normal_pos(F.col("p")), lexical.normal_pos(F.col("p"), "wordnet")).collect()] == [("NOUN,VERB", "X,VERB"), ("ADJ", "ADJ"), ("X", "X")]


def test_lax_records_and_directives(spark, tmp_path):
    assert [r[4] for r in rskv.records(["a=1", "b: 2"], lax=True)] == [{"a": "1", "b": "2"}] and list(rskv.records(["a=1"])) == []
    packed = base64.b64encode(zlib.compress(b"long text")).decode()
    text = f"#SET: s\n#ENCODE: t:base64\n#COMPRESS: t:zlib\n#VALIDATE: t:required, n:/[0-9]+/\n#PROVENANCE: me\nt: {packed}\nn: x\n"
    (_, _, _, meta, record), = rskv.records(text.split("\n"))
    assert record["t"] == "long text" and meta["provenance"] == "me"
    assert rskv.invalid(record, meta["validate"]) == ["n"] and rskv.invalid({}, meta["validate"]) == ["t"]
    with pytest.raises(rskv.RskvError):
        list(rskv.records(["#SET: s", "#ENCODE: t:base64", "t: ???"], strict=True))
    (tmp_path / "a.rskv").write_text("#SET: s\n#SCHEMA: n:int, t:str\nn: 1\nt: a\nextra: e\n---ROW---\nn: two\n")
    t = rskv.as_table(rskv.read_files(spark, str(tmp_path / "a.rskv")), "s")
    assert t.columns == ["position", "n", "t", "extra"] and [tuple(r) for r in t.orderBy("position").collect()] == [(0, 1, "a", "e"), (1, None, None, None)]
