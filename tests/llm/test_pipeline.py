import random
from pathlib import Path

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def test_stages_on_a_fixture(spark, tmp_path):
    """Near duplicates by brute force, sequences by an exact count of tokens, and what each stage leaves."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    names = "the of and a in to house river walks slowly under tree with his friend said old road stone hill".split()
    prose = [" ".join(rng.choice(names) + rng.choice(["", "", "er"]) for _ in range(90)).capitalize() + "." for _ in range(30)]
    rows = [(k, prose[k % 30] if k < 40 else prose[k - 40] + " And more of it.", "en", f"s{k % 3}", 0) for k in range(50)]
    rows += [(100 + k, " ".join(rng.choice(["BUY!!!", "$$$", "###", "%%%"]) for _ in range(60)), "en", "bad", 0) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, good), (_, distinct), (_, mixed), _ = corpus_pipeline.STAGES
    kept = good(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(50))
    text = {i: t for i, t, *_ in rows if i < 100}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in text.items() for w in [t.lower().split()]}
    alone, group = [], {}
    for i in text:
        group[i] = next((group[j] for j in alone if 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])), i)
        if group[i] == i:
            alone.append(i)
    one = distinct(spark, kept, str(tmp_path))
    assert {r.doc_id for r in one.collect()} == set(alone) and len(alone) == 30
    more = mixed(spark, one, str(tmp_path)).collect()
    assert {r.doc_id for r in more} == set(alone) and len(more) <= 2 * len(alone)
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    total = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in more)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == total and len({r.sequence_id for r in packed}) == -(-total // 2048)


def test_folder_of_tables_is_all_it_reads():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    assert Path(corpus_pipeline.__file__).parent == Path(__file__).parents[2]
