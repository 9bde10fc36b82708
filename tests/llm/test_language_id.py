import zlib

from murmuration.llm import language_id, queries
from tests.llm.cases import awkward, empty

PROSE = {
    "en": "the quick brown fox jumps over the lazy dog and then the other fox thinks that it would rather sleep there",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und dann denkt der andere Fuchs dass er lieber schläft",
}


def test_held_out_accuracy(spark, sf_dir):
    langs = {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}
    got = queries.op1_language_id(spark, sf_dir).collect()
    assert len(got) == len(langs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in langs if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r.lang_pred == langs[r.doc_id].lang for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark):
    train = spark.createDataFrame([(k, t, lang) for k in range(9) for lang, t in PROSE.items()], "doc_id long, text string, lang string")
    dictionaries = language_id.learn_dictionaries(train)
    assert sorted(dictionaries) == ["de", "en"]
    docs = awkward(spark, ["the dog and the fox", "der Hund und der Fuchs", "THE OTHER FOX THINKS", "?"])
    got = {r.doc_id: r for r in language_id.identify_language(docs, dictionaries).collect()}
    assert [got[100 + k].lang_pred for k in range(4)] == ["en", "de", "en", "und"]
    for k in (1, 2, 3, 9):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert got[8].lang_pred in PROSE
    assert language_id.identify_language(empty(spark), dictionaries).count() == 0


def test_nothing_to_learn_from(spark):
    assert language_id.learn_dictionaries(empty(spark)) == {}
    assert {r.lang_pred for r in language_id.identify_language(awkward(spark), {}).collect()} == {"und"}


def test_ids_and_order_do_not_matter(spark):
    rows = [(k, t, lang) for k in range(9) for lang, t in PROSE.items()]
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    two = spark.createDataFrame([(-k, t, lang) for k, t, lang in reversed(rows)], "doc_id long, text string, lang string")
    assert language_id.learn_dictionaries(one) == language_id.learn_dictionaries(two)


def test_short_documents_are_kept_like_long_ones(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").where("text IS NOT NULL")
    dictionaries = language_id.learn_dictionaries(docs.where(language_id.training_rows(docs)))
    texts = [r.text for r in docs.select("text").distinct().limit(400).collect()]
    words = [t.split() for t in texts if len(t.split()) >= 40]
    compressors = language_id.Compressors(dictionaries)
    for size in (2, 5, 10, 40):
        found = [compressors.best(" ".join(w[:size])) for w in words]
        told = [f for f in found if f[0] != language_id.UNKNOWN]
        assert sum(f[1] >= language_id.MIN_MARGIN for f in told) >= 0.9 * len(told), size
    assert compressors.best("eser thed nt of")[1] > 0


def test_ties_of_short_texts_are_told_from_the_dictionaries():
    compressors = language_id.Compressors({k: t.lower().encode() * 20 for k, t in PROSE.items()})
    for text, lang in (("the", "en"), ("der", "de"), ("that it", "en"), ("und er", "de"), ("fuchs", "de"), ("dog", "en")):
        name, margin = compressors.best(text)
        assert name == lang and margin >= language_id.MIN_MARGIN, text
    same = language_id.Compressors({"a": b"the same words " * 9, "b": b"the same words " * 9})
    assert same.best("the same") == ("a", 0.0)


def test_pieces_come_from_the_whole_text_and_copies_count_once(spark):
    opening = "licence words that every text begins with " * 30
    bodies = [" ".join(f"{chr(97 + k % 26)}{chr(97 + j % 26)}body" for j in range(900)) for k in range(26)]
    rows = [(k, opening + b, "en") for k, b in enumerate(bodies)] + [(100 + k, "copied text", "en") for k in range(5000)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.learn_dictionaries(train, sample_docs=30, dictionary_bytes=1 << 20)["en"].decode()
    assert learned.count("body") > 2 * learned.count("licence")  # from the first characters it would be none
    assert sum(f"{chr(97 + k)}abody" in learned for k in range(26)) > 13  # 5,000 copies do not lower the share of others
