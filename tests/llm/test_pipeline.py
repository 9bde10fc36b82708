import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from murmuration.llm import queries
from tests.compare import compare, duck
from tests.llm.cases import awkward
from tests.llm.test_bpe import PATH
from tests.llm.test_decontaminate import words
from tests.llm.test_simhash import plain_fingerprint


def test_sql(spark, sf_dir):
    from murmuration.llm.oracles import oracles

    con = duck(sf_dir)
    for name, sql in oracles().items():
        assert compare(spark, con, queries.registered()[name], sql, sf_dir) == "", name


def plain_stages(docs, items, languages):
    """Ids that stay after each stage, by brute force; what is rejected by compression is taken as given."""
    kept = [d for d in docs if d.doc_id in languages]
    yield [d.doc_id for d in kept]
    best = {}
    for d in kept:
        text = "".join(d.text.translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))
        if text not in best or (-len(d.text), d.doc_id) < (-len(best[text].text), best[text].doc_id):
            best[text] = d
    kept = list(best.values())
    yield [d.doc_id for d in kept]
    prints = [(d, plain_fingerprint(d.text)) for d in sorted(kept, key=lambda d: d.doc_id)]
    groups = []
    for d, f in prints:
        near = [g for g in groups if any((f ^ o).bit_count() <= 2 for _, o in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [(d, f)])]
    kept = [min((d for d, _ in g), key=lambda d: d.doc_id) for g in groups]
    yield [d.doc_id for d in kept]
    windows = {}
    for text in items:
        w = words(text)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(size, set()).add(tuple(w[k : k + size]))
    clean = []
    for d in kept:
        w, hit = words(d.text), set()
        for size, wanted in windows.items():
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wanted:
                    hit |= set(range(k, k + size))
        if not hit or 20 * len(hit) < len(w):
            clean.append(d.doc_id)
    yield clean


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = queries.table(spark, sf_dir, "documents")
    items = [r.text for r in queries.table(spark, sf_dir, "benchmark").collect()]
    rows = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if k == 0:
            assert len(got) > 0.95 * len(rows)
            wanted = list(plain_stages(rows, items, set(got)))
        assert got == sorted(wanted[min(k, 3)]), name
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(PATH), {r.doc_id: r.text for r in rows}
    assert all(r.token_ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in docs.collect())
    assert corpus_pipeline.run(spark, sf_dir).count() == len(wanted[3])


def test_awkward_rows_pass_all_stages(spark, sf_dir):
    docs = awkward(spark).withColumns({"source": F.lit("s"), "n_chars": F.lit(1)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op5_html_extraction", "op8_bpe"])
def test_every_row_has_its_result(spark, sf_dir, name):
    rows = queries.table(spark, sf_dir, "pages" if "html" in name else "documents").count()
    assert queries.registered()[name](spark, sf_dir).count() == rows


def test_one_row_of_each_group_whatever_the_ids(spark, sf_dir):
    base = " ".join(f"word{k}" for k in range(300))
    other, third = " ".join(f"other{k * k}" for k in range(300)), " ".join(f"third{k * 7}" for k in range(300))
    rows = [(1, base), (2, base), (2, other), (None, third), (None, third), (5, base), (1, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text) for r in near) == sorted([(1, base), (2, other), (0, third)])
    exact = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text) for r in exact) == sorted([(1, base), (2, other), (0, third)])
