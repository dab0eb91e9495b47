from pyspark.sql import Row
from pyspark.sql import functions as F

from aliasmith.functions import text
from aliasmith.operators import embedding, mining, store
from aliasmith.plans import datapack, linking
from aliasmith.sources import files, pages
from aliasmith.streaming.linking import link_stream

DUMP = """<mediawiki>
<page><title>Anna Smith</title><ns>0</ns><id>1</id><revision><id>9</id><timestamp>2011-02-03T04:05:06Z</timestamp><text>'''Anna Smith''' met [[bob jones|Bob J.]] in [[Paris]] and Bob J. again.
{{Infobox x}} More on [[Paris#History|the city]] and [[File:x.png]].
==Early life==
text here</text></revision></page>
<page><title>Bob Jones</title><ns>0</ns><id>2</id><revision><id>9</id><timestamp>x</timestamp><text>#REDIRECT [[Robert Jones]]</text></revision></page>
<page><title>Bob jones</title><ns>0</ns><id>6</id><revision><id>9</id><text>#redirect [[Bob Jones]]</text></revision></page>
<page><title>Robert Jones</title><ns>0</ns><id>3</id><revision><id>9</id><text>A man of [[Paris]]. {{stub}}</text></revision></page>
<page><title>Paris</title><ns>0</ns><id>4</id><revision><id>9</id><text>{{disambig}} many</text></revision></page>
<page><title>Help:Me</title><ns>12</ns><id>5</id><revision><id>9</id><text></text></revision></page>
</mediawiki>"""


def dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP)
    return mining.cut(pages.read_dump(spark, str(tmp_path / "d.xml")))


def test_dump(spark, tmp_path):
    p = {r.page_id: r for r in dump(spark, tmp_path).collect()}
    assert str(p[1].revision) == "2011-02-03 04:05:06" and p[2].revision is None
    assert (p[1].n_infobox, p[1].n_sections, p[4].is_disambig, p[3].is_stub, p[2].is_redirect) == (1, 1, True, True, True)
    kinds = {r.type: r.n for r in mining.page_type_counts(dump(spark, tmp_path)).collect()}
    assert kinds == {"TOTAL": 6, "REDIRECT": 2, "DISAMBIGUATION": 1, "EMPTY": 1, "ARTICLE": 2, "STUB": 1}
    assert {r.page_id for r in mining.docno_filter(dump(spark, tmp_path)).collect()} == {1, 2, 3, 4, 6}
    assert [r.docno for r in mining.docno_assign(dump(spark, tmp_path)).orderBy("page_id").collect()] == [1, 2, 3, 4, 5, 6]


def test_mining(spark, tmp_path):
    p = dump(spark, tmp_path)
    links = sorted((r.source, r.target, r.anchor) for r in mining.links(p).collect())
    assert links == [("Anna Smith", "Bob jones", "bob j"), ("Anna Smith", "Paris", "paris"), ("Anna Smith", "Paris", "the city"), ("Bob Jones", "Robert Jones", "robert jones"), ("Bob jones", "Bob Jones", "bob jones"), ("Robert Jones", "Paris", "paris")]
    assert {(r.source, r.target) for r in mining.redirect_closure(mining.redirects(p)).collect()} == {("Bob Jones", "Robert Jones"), ("Bob jones", "Robert Jones")}
    pack = {(r.alias, r.entity_id): (r.phrase_freq, r.alias_freq, r.alias_entity_freq) for r in datapack.mine(p).collect()}
    assert pack["bob j", "Robert_Jones"] == (3, 1, 1) and pack["paris", "Paris"][1:] == (2, 2)
    c = datapack.candidates(p)
    got = linking.link(spark.createDataFrame([(1, "Who is Bob J.?")], "query_id int, text string"), linking.best_entities(c), -50.0).collect()
    assert [(r.alias, r.start, r.end) for r in got] == [("bob j", 2, 3)]


def test_redirect_cycles(spark):
    r = spark.createDataFrame([("A", "B"), ("B", "A"), ("X", "A"), ("C", "D"), ("D", "E"), ("S", "S")], "source string, target string")
    got = {x.source: x.target for x in mining.redirect_closure(r).collect()}
    assert got == {"A": "A", "B": "B", "X": "B", "C": "E", "D": "E"}


def test_tsv(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('a b\t1\t2\tX\t3\nq"r\tbad\t2\tY\t3\n')
    got = files.read_tsv(spark, str(tmp_path / "c.tsv"), files.COUNTS).collect()
    assert got[0] == Row("a b", 1, 2, "X", 3) and got[1].alias == 'q"r' and got[1].phrase_freq is None
    files.write_tsv(files.read_tsv(spark, str(tmp_path / "c.tsv"), files.COUNTS), str(tmp_path / "out"))
    assert files.read_tsv(spark, str(tmp_path / "out"), files.COUNTS).count() == 2


def test_line_formats(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    bad = store.parse_feature_lines(lines("lonely\u00011\u00011\u00011\u00011\u00011\u00011\u00011\u00010", "x", "", "a\u00011\u00012\u00013\u00010\u00010\u00014\u00015\u00011\t7\u00011\u00011\u00012\u00011\u00011\u00013\u00014")).collect()
    assert [(r.alias, r.qaf, r.qac, r.qat, r.laf, r.lat, r.entity_id, r.qef, r.qaef, r.let, r.laet) for r in bad] == [("a", 1, 2, 3, 4, 5, 7, 1, 2, 3, 4)]
    assert files.entity_names(lines("A\t1", "B\t1", "C\tx")).collect() == [Row(1, "B")]
    assert files.type_names(lines("3\t/x/y", "bad")).collect() == [Row(3, "/x/y")]
    assert files.entity_types(lines("0\t1\tNew York\tplace")).collect() == [Row("New_York", "place")]
    j = files.judgments(lines("query\tid\tlabel\tlocation", "q\tE\tFair\tus", "q\t12\tGood\tus")).collect()
    assert [(r.query, r.entity, r.relevant) for r in j] == [("q", "E", False)]
    assert [tuple(r) for r in files.type_phrases(lines("t\t(2.7,a b),(1,c)")).collect()] == [("t", 2, "a b"), ("t", 1, "c")]
    assert [tuple(r) for r in files.type_words(lines("t\ta\u00013\tb\u00012")).collect()] == [("t", 0, "a", 3), ("t", 1, "b", 2)]
    assert lines("{(a),(b)}").select(files.flatten_bag(F.col("value"))).first()[0] == "a\tb"
    assert [r.word for r in files.word_list(lines(" a ", "", "b")).collect()] == ["a", "b"]
    v = files.vectors(lines("2\t2", "w\t1.5\t-2")).collect()
    assert [(r.word, r.vector) for r in v] == [("w", [1.5, -2.0])]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(text.normalize(lit("ad. - asd. ; ; Xxvv.com   one two "))) == "ad asd xxvv com one two"
    assert one(text.tokens(lit(" .. "))) == []
    spans = one(text.normalize_with_spans(lit("..Ab, c1 ")))
    assert [tuple(s) for s in spans] == [("ab", 2, 4), ("c1", 6, 8)]
    assert one(text.fold(lit("Éa^b`c  D"))) == "ea b c d" and one(text.normalize_text(lit("Éa^b`c  D"))) == "eabc d"
    assert one(text.normalize_regexp_copy(lit("A-b.  C"))) == "ab c"
    assert one(text.capitalize_first(lit(""))) == "" and one(text.capitalize_first(lit("éa"))) == "éa"
    assert one(text.html_unescape_twice(lit("a &amp;lt; b"))) == "a < b"
    assert one(text.trigrams(F.array(lit("a"), lit("b"), lit("c")))) == ["a", "a_b", "a_b_c", "b_c", "b", "c"]
    assert one(text.letter_pairs(lit("abc"))) == ["ab", "bc"] and one(text.letter_pairs(lit("a"))) == []
    assert one(F.isnan(text.lexical_similarity(lit("a"), lit("b"))))
    assert one(text.count_object(lit("xax"), "x")) == 0 and one(text.count_object(lit("axx"), "x")) == 2
    assert one(text.strip_wiki(text.prepend_wiki(lit("E")))) == "E"
    assert one(text.intent_part(lit("tennis songs"), lit("Tennis_%28band%29"))) == " songs"
    assert one(text.decode(text.encode(lit("a b*é")))) == "a b*é"
    f = spark.createDataFrame([("Ǻngström ô 한",)], "t string")
    folded = text.fold(F.col("t"))
    assert f.select(folded).first()[0] == f.select(text.fold(folded)).first()[0] == "angstrom o 한"
    assert f.select(text.nfd_strip_exact(F.col("t"))).first()[0].startswith("Angstrom o ")


def test_quantization_round_trip(spark):
    v = spark.createDataFrame([("a", [0.31, -0.77, 0.0])], "word string, vector array<double>")
    back = embedding.dequantize_table(embedding.quantize_table(v, 10), 10).first().vector
    assert all(abs(x - y) <= 0.1 for x, y in zip(back, [0.31, -0.77, 0.0])) and back[2] == 0.0


def test_kmeans_seeded_and_logistic(spark):
    v = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.9, 0.0]), ("c", [0.0, 1.0]), ("d", [0.1, 0.9])], "word string, vector array<double>")
    got = {r.word: r.cluster for r in embedding.cluster_seeded(v, ["a", "c"]).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1}
    assert {r.word for r in embedding.kmeans_cosine(v, 2).collect()} == set("abcd")
    d = spark.createDataFrame([("e", "a b"), ("f", "c d nothing")], "entity string, words string")
    w = {r.entity: r.vector for r in embedding.train_entities(d, v, c=0.1, most=500).collect()}
    assert w["e"][0] > w["e"][1] and w["f"][1] > w["f"][0]


def test_stream(spark, tmp_path):
    c = spark.createDataFrame([("red ring", 1, 1, 2, 5, 9, 0, 3, 1, 1, 1, 5, 5)], "alias string, qaf long, qac long, qat long, laf long, lat long, ix int, entity_id int, type int, qef long, qaef long, let long, laet long")
    spark.createDataFrame([(1, "a Red ring!"), (2, "none")], "query_id int, text string").write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("query_id int, text string").parquet(str(tmp_path / "in"))
    link_stream(q, linking.best_entities(c), str(tmp_path / "out"), str(tmp_path / "cp"), -50.0).awaitTermination()
    assert [(r.query_id, r.alias) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "red ring")]
