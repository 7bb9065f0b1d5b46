import public_tokenizers
import sentencepiece

import corpus_pipeline as P
from test_mixing import check
from test_simhash import plain_components
from test_substrings import brute
from test_toxicity import sample

from plumbline.llm.mixing import mix
from plumbline.llm.toxicity import fit


def test_stages_against_plain_versions(spark, tmp_path):
    rows = [(i, t, "en", "s%d" % (i % 4), len(t)) for i, t, _ in sample(5, 300)]
    labels = [(i, y) for i, _, y in sample(5, 300)]
    clean = [i for i, y in labels if not y]
    shared = " ".join(f"shared{i}" for i in range(40))
    rows += [(1000 + k, rows[clean[k]][1], "de", "copy", 5) for k in range(10)]
    rows += [(2000 + k, f"start{k} " * 3 + shared + f" end{k}" * (k + 1), "en", None, 9) for k in range(4)]
    rows += [(3000, None, None, "s1", None), (3001, "", None, None, 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)

    one = P.toxicity(spark, docs, sf)
    assert one.schema == docs.schema
    model = fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).scorer()
    first = sorted(tuple(r) for r in one.collect())
    assert first == sorted(r for r in rows if model.scores([r[1] or ""])[0] < 0.5) and len(first) < len(rows)

    def again(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    two = P.near_duplicates(spark, again(one, "one"), sf)
    keep = {i for i, _, c in plain_components([r[:2] for r in first]) if i == c}
    second = {r.doc_id: r for r in two.collect()}
    assert second.keys() == keep and 1000 not in keep

    three = P.repeated_passages(spark, again(two, "two"), sf)
    third = {r.doc_id: r for r in three.collect()}
    want = {i: removed for i, _, removed, _ in brute([(r.doc_id, r.text) for r in second.values()])}
    assert want[2001] == 40 and third.keys() == second.keys()
    for i, r in third.items():
        before = second[i].text
        assert (r.text == before) if not want[i] else len(r.text.split()) == len(before.split()) - want[i]
        assert not want[i] or r.n_chars == len(r.text)

    three = again(three, "three")
    mixed = mix(three).collect()
    check([(r.doc_id, r.text, r.source) for r in third.values()], mixed)
    four = P.source_mix(spark, three, sf)
    assert four.columns == docs.columns
    words = {}
    for r in four.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r.doc_id: r.taken for r in mixed if r.taken}

    five = P.token_ids(spark, again(four, "four"), sf).collect()
    ref = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = sorted((r.doc_id, tuple(ref.encode(r.text))) for r in four.collect())
    assert sorted((r.doc_id, tuple(r.ids)) for r in five) == texts

    assert sorted(map(repr, P.run(spark, sf).collect())) == sorted(map(repr, five))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
