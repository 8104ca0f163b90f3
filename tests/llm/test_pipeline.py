"""The pipeline against a brute-force version of each of its stages, on one small corpus."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from accesslens.llm import mil_quality

FOOTER = "All rights reserved by the site."
ITEM = " ".join(f"quiz{i}" for i in range(20))


def corpus():
    """(doc_id, text, lang, source, n_chars): prose, junk, near copies, benchmark items, a footer."""
    chance = random.Random(3)
    rows = []
    for i in range(240):
        words = [f"{chance.choice('bcdfglmnprst')}{chance.choice('aeiou')}{chance.randrange(400)}" for _ in range(60)]
        text = " ".join(words) + ". "
        if i % 3 == 0:
            text = "%%% ### " * 30 + str(i)
        elif i % 20 == 1:
            text += "\n" + ITEM.upper() + "\n"
        rows.append([i, text + ("\n" + FOOTER if i % 2 else ""), "en", f"site{i % 3}"])
    rows += [[300 + i, rows[i][1].replace(". ", " more. ", 1), "en", "copies"] for i in range(0, 60, 4)]
    rows += [[400, None, "en", "a"], [401, "", None, None], [402, "Two words.", "en", "a"]]
    return [(*row, len(row[1] or "")) for row in rows]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(docs, model):
    kept = [(i, t or "", s or "") for i, t, _, s, _ in docs if model.scores([mil_quality.passages((t or "").encode())])[0] >= 0.5]

    def bare(line):
        return line.strip(" \t\r")

    pages = {(s, t) for _, t, s in kept}
    bad = set()
    for site in {s for s, _ in pages}:
        own = [{bare(line) for line in t.split("\n")} for s, t in pages if s == site]
        for line in set().union(*own) - {""}:
            n = sum(line in page for page in own)
            if n >= 5 and n / len(own) > 0.05:
                bad.add((site, line))
    cleaned = {i: "\n".join(x for x in t.split("\n") if (s, bare(x)) not in bad) for i, t, s in kept}

    sets = {i: shingles(t) for i, t in cleaned.items()}
    first, before = {i: i for i in sets}, None
    while before != first:
        before = dict(first)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    first[a] = first[b] = min(first[a], first[b])
    item = shingles(ITEM)
    return bad, {
        i: t for i, t in cleaned.items() if first[i] == i and len(sets[i] & item) < 0.8 * len(item)
    }


def test_pipeline_agrees_with_brute_force(spark, tmp_path):
    docs = corpus()
    tables = {
        "documents": (docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"),
        "labels": ([(d[0], int(d[0] % 3 > 0), 0) for d in docs if d[0] < 240], "doc_id BIGINT, quality INT, toxic INT"),
        "benchmark": ([(1, ITEM), (2, None)], "item_id BIGINT, text STRING"),
    }
    frames = {}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        frames[name] = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
    model = mil_quality.train(frames["documents"], frames["labels"])
    bad, want = brute_force(docs, model)
    assert FOOTER in {line for _, line in bad} and 40 < len(want) < 200

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(want)
    for i, text in want.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_stages_filter_rows_not_identifiers(spark, tmp_path):
    prose = {n: " ".join(f"{n}{i}" for i in range(60)) for n in "abcde"}
    bad = f"{prose['e']} {ITEM}"
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"

    def frame(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(5)

    def kept(found):
        return sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)

    spark.createDataFrame([(1, ITEM), (2, None)], "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(None, prose["a"]), (None, None), (1, prose["b"]), (2, prose["c"])]
    docs = frame([*clean, (None, bad), (1, bad), (3, bad)])
    found = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    assert kept(found) == sorted(clean, key=str)

    rows = [(5, prose["a"])] * 3 + [(None, prose["a"])] + [(None, prose["b"])] * 2 + [(5, prose["c"])]
    rows += [(7, prose["d"]), (6, prose["d"] + " x"), (None, None), (None, None), (8, "")]
    found = corpus_pipeline.near_dedup(spark, frame(rows), str(tmp_path))
    assert found.columns == docs.columns
    want = [(5, prose["a"]), (None, prose["b"]), (5, prose["c"]), (6, prose["d"] + " x"), (None, None), (None, None), (8, "")]
    assert kept(found) == sorted(want, key=str)
