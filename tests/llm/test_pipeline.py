"""Pipeline stages against plain Python on a small fixture."""

import random
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from gyrespark.llm import bpe
from test_simhash import plain_groups, plain_print
from test_suffixes import plain as plain_repeats


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgéh") for _ in range(rng.randrange(2, 8)))
    line = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    shared = line() + " " + line()
    rows = []
    for i in range(80):
        text = "\n".join(line() for _ in range(rng.randrange(6, 12)))
        text += "\n" + shared if i % 4 == 0 else ""
        rows.append((i, text, ["en", None][i % 2], ["a", "b", "c", None][i % 4], len(text)))
    near = rows[10][1].replace(".", ". ", 1)
    rows += [(200, rows[10][1], "en", "a", len(rows[10][1])), (201, near, "en", "b", len(near)), (202, "too short", "en", "a", 9),
             (203, None, "en", "a", None), (204, " ".join(f"LOUD{j}!!" for j in range(90)), "en", "c", 700)]
    return rows


def test_stages_equal_plain_python(spark, tmp_path):
    rows = corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(schema.replace(",", " ").split()[::2])
    got = {name: {r.doc_id: r for r in frame.collect()} for name, frame in out.items()}
    clean = got["quality rules"]
    assert set(clean) == {i for i, *_ in rows} - {202, 203, 204}
    groups = plain_groups({i: plain_print(r.text) for i, r in clean.items()})
    one = got["SimHash near-dedup"]
    assert set(one) == set(groups.values()) and 200 not in one
    cut = got["suffix-array dedup"]
    want = {i: (b, removed) for i, b, removed, *_ in plain_repeats([(i, r.text) for i, r in one.items()], 50)}
    assert {i: len(one[i].text.encode()) for i in one} == {i: b for i, (b, _) in want.items()}
    assert all(0 <= len(one[i].text.encode()) - len(r.text.encode()) - want[i][1] < 8 for i, r in cut.items())
    assert sum(removed > 0 for _, removed in want.values()) > 10
    times = Counter(r.doc_id for r in out["source mixing"].collect())
    assert set(times) <= set(cut) and max(times.values()) <= 2
    library = Tokenizer.from_file(bpe.tokenizer_path())
    ids = Counter(r.doc_id for r in out["BPE encoding"].collect())
    assert ids == times
    for i, r in got["BPE encoding"].items():
        assert r.n_tokens == len(library.encode(cut[i].text, add_special_tokens=False).ids)
    assert np.mean([r.text == one[i].text for i, r in cut.items()]) > 0.5


def test_run_on_tables(spark):
    frame = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and frame.count() > 0
