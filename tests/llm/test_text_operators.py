"""The text operators against brute force, on small tables with all the awkward rows."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from check import compare, duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from accesslens.llm import bpe_lexicon, exact_dedup, hidden_markov, mil_quality, pii_crf, site_templates
from accesslens.llm.common import most_frequent
from accesslens.llm.decontamination import doublings, find_items
from accesslens.llm.exact_dedup import exact_duplicates
from accesslens.llm.line_dedup import drop_boilerplate_lines
from accesslens.llm.queries import SENTENCE_END, SQL
from accesslens.llm.sketch_dedup import near_duplicates, shingle_set, sketch
from accesslens.llm.token_counts import RULES, _encoding, allocate, token_counts

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id STRING, row STRING, host STRING"


def docs(spark, rows):
    """(doc_id, text, source) tuples, with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y", "z") for i, t, s in rows], SCHEMA)


PROSE = " ".join(f"word{i}" for i in range(60))
AWKWARD = [
    (1, PROSE, "a"), (2, PROSE.upper(), "a"), (2, PROSE.upper(), "a"), (3, PROSE + " more", None),
    (4, None, "a"), (5, "", "b"), (6, " \n\t", "b"), (None, PROSE, "b"), (7, "two words", "b"),
    (8, "Two Words", None), (9, "x" * 100_000, "b"), (10, PROSE.replace("word30", "other"), "a"),
]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    verdict, _ = compare(spark, duck(sf_dir), sf_dir, name)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_exact_duplicates(spark, keep, best):
    found = exact_duplicates(docs(spark, AWKWARD).repartition(7), keep=keep, fan_in=2).collect()
    groups = {}
    for i, text, _ in AWKWARD:
        groups.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""), []).append(i)
    want = [
        (i, best([x for x in ids if x is not None], default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items() for i in ids
    ]
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_runs_are_merged_slice_by_slice(spark, monkeypatch, fan_in):
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", 16)
    rows = [(i, f"text {i % 37}" if i % 3 else "copied everywhere", "a") for i in range(400)]
    found = exact_duplicates(docs(spark, rows).repartition(13), fan_in=fan_in).collect()
    ids = {}
    for i, text, _ in rows:
        ids.setdefault(text, []).append(i)
    want = {i: (min(same), len(same), i == min(same)) for same in ids.values() for i in same}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in found} == want
    assert exact_duplicates(docs(spark, []), fan_in=fan_in).count() == 0


def test_a_merge_compares_neighbours_and_leaves_sorted_runs(spark):
    rows = [(run, 0, bytes([d]), 1, d, 10 * run + d, 1) for run in range(4) for d in (3, 1, 2, 3 + run) if d <= 3 + run]
    rows = sorted(set(rows), key=str)
    level = spark.createDataFrame(rows, "run INT, slice INT, digest BINARY, size INT, check BIGINT, keep_id BIGINT, group_size BIGINT")
    merged = exact_dedup.merge_runs(level, F.min, 2)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    got = [(r["run"], r["digest"][0], r["keep_id"], r["group_size"]) for r in merged.collect()]
    want = {}
    for run, _, digest, _, _, keep, n in rows:
        best, texts = want.get((run // 2, digest[0]), (10**6, 0))
        want[run // 2, digest[0]] = min(best, keep), texts + n
    assert sorted(got) == sorted((*key, *value) for key, value in want.items())
    for run in (0, 1):
        digests = [d for r, d, _, _ in got if r == run]
        assert digests == sorted(digests)
    assert "Aggregate" not in plan and plan.count("Exchange") == 1


def test_near_duplicates_agree_with_brute_force(spark):
    words = [f"w{i}" for i in range(300)]
    rows = list(AWKWARD)
    for i in range(40):  # one group with edits from none to many
        own = words[:120]
        for j in range(i % 9):
            own[(i * 7 + j * 13) % 120] = f"edit{i}x{j}"
        rows.append((100 + i, " ".join(own), "c"))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows), k=4).collect()}
    sets = {i: set(shingle_set((t or "").encode(), 4).tolist()) for i, t, _ in rows if i is not None}
    component = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low = min(component[a], component[b])
                    changed |= component[a] != low or component[b] != low
                    component[a] = component[b] = low
    assert got == component | {None: None}


def test_near_duplicates_of_unlike_copies_and_repeated_identifiers(spark):
    """A group most of whose pairs are just below the threshold, and one identifier with two texts."""
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in random.choice(150, random.integers(1, 8), replace=False):
            own[at] = f"edit{random.integers(0, 4)}at{at}"
        rows.append((i % 140, " ".join(own), "c"))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows), k=4).collect()}
    sets = [(i, set(shingle_set(t.encode(), 4).tolist())) for i, t, _ in rows]
    component = {i: i for i, _ in sets}
    links = [(i, j) for i, a in sets for j, b in sets if i < j and 100 * len(a & b) >= 80 * len(a | b)]
    before = None
    while before != component:
        before = dict(component)
        for i, j in links:
            component[i] = component[j] = min(component[i], component[j])
    assert 1 < len(set(component.values())) < 140
    assert got == component


def test_fine_sketch_bits_agree_as_often_as_expected():
    random = np.random.default_rng(2)
    both = random.integers(0, 2**63, 1100).astype(np.uint64)
    for shared in (600, 900):  # of 1,000 and 1,000 + (1,000 - shared) more
        one, two = both[:shared + 100], np.concatenate([both[:shared], both[-100:]])
        equal = ((sketch(one, 1024) & np.uint64(1)) == (sketch(two, 1024) & np.uint64(1))).mean()
        assert abs(equal - (1 + shared / (shared + 200)) / 2) < 0.06


def test_sketch_estimates_similarity_for_sets_of_any_size():
    random = np.random.default_rng(1)
    for size in (1, 3, 40, 2000):
        x = random.integers(0, 2**63, size).astype(np.uint64)
        assert len(sketch(x)) == 96 and (sketch(x) == sketch(x[::-1].copy())).all()
    both = random.integers(0, 2**63, 1200).astype(np.uint64)
    assert abs((sketch(both[:1000]) == sketch(both[200:])).mean() - 2 / 3) < 0.2


def test_benchmark_items_inside_long_documents(spark):
    item = " ".join(f"q{i}" for i in range(30))
    long = " ".join(f"filler{i}" for i in range(20_000))
    rows = [(1, f"{long} {item.upper()} {long}", "a"), (2, long, "a"), (None, item, "a"), (3, None, "a"), (4, "q1 q2", "a")]
    items = spark.createDataFrame([(7, item), (8, "q1 q2"), (9, ""), (10, None)], "item_id BIGINT, text STRING")
    got = {(r["doc_id"], r["item_id"]) for r in find_items(docs(spark, rows), items).collect()}
    assert got == {(1, 7), (None, 7), (4, 8)}
    assert find_items(docs(spark, rows[:0]), items).count() == 0
    assert find_items(docs(spark, rows), items.limit(0)).count() == 0


def test_sketches_get_denser_for_shorter_items():
    assert doublings(17) == 0 and doublings(8) > 0 and doublings(1) is None


def test_boilerplate_lines_go_and_copies_do_not_count(spark):
    rows = [(i, f"line {i}\nshared footer \n\nmore {i}", "site") for i in range(10)]
    rows += [(100 + i, "copied page\nof two lines", "site") for i in range(50)] + [(200, None, None)]
    got = {r["row"]["doc_id"]: (r["text"], r["n_dropped"]) for r in drop_boilerplate_lines(docs(spark, rows), ratio=0.3).collect()}
    assert got[3] == ("line 3\n\nmore 3", 1) and got[120] == ("copied page\nof two lines", 0) and got[200] == ("", 0)


def test_page_text():
    page = (
        "<html><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1>"
        "<p>One <b>two</b><br>three<p>four<aside>no</aside></article><div class='comments'><p>me</p></div></body>"
    )
    tree = site_templates.hash_subtrees(site_templates.parse(page))
    assert site_templates.main_text(tree) == "A & B\nOne two three\nfour"
    assert site_templates.main_text(site_templates.parse("")) == ""
    assert site_templates.main_text(site_templates.parse("<p>" * 50_000 + "deep")) == "deep"


def test_pages_lose_their_sites_template(spark):
    rows = [(i, f"http://h.example/{i}", f"<div><div>Site slogan</div><div>Story {i} told</div></div>") for i in range(8)]
    pages = spark.createDataFrame([*rows, (90, None, None)], "page_id BIGINT, url STRING, html STRING")
    got = {r["page_id"]: r["text"] for r in site_templates.extract_text(pages).collect()}
    assert got[3] == "Story 3 told" and got[90] == ""


def test_counts_choose_what_goes_from_prose_and_beside_articles(spark):
    def page(i, story):
        return (
            f"<body><p>Read us daily</p><div>Beside {i}</div><article><h1>Title {story}</h1><p>Text <b>bold</b> "
            f"of<br>{story}</p><ul><li>Buy it</li><li>Item {story}</li></ul></article><article><p>Second {story}</p></article>"
            "<p>Read us daily</p><p><b>bold</b></p></body>"
        )

    rows = [(i, f"http://h.example/{i}", page(i, i)) for i in range(20)]
    rows += [(100 + i, f"http://h.example/c{i}", page(100 + i, "copied")) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    got = {r["page_id"]: r["text"] for r in site_templates.extract_text(pages).collect()}
    for i, story in [(3, 3), (103, "copied")]:
        assert got[i] == f"Beside {i}\nTitle {story}\nText bold of {story}\nItem {story}\nSecond {story}"


def _article_text(page):
    """The text of a page's article by a plainer reading: everything between its tags, without markup."""
    inner = re.sub(r"<br>", " ", page.partition("<article>")[2].partition("</article>")[0])
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_no_text_of_an_article_is_lost_and_nothing_else_stays(spark):
    """The given pages hold one article each; spaces aside, its text is all that may come out."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = site_templates.extract_text(pages).select("html", "text").collect()
    assert len(rows) > 1000
    assert all("".join(r["text"].split()) == "".join(_article_text(r["html"]).split()) for r in rows)
    # By the counts alone, where a host has pages enough to count.
    host = F.regexp_extract("url", "//([^/]+)", 1)
    large = pages.withColumn("host", host).join(pages.groupBy(host.alias("host")).count().where("count >= 20"), "host")
    rows = site_templates.extract_text(large.select("page_id", "url", "html"), words=False).select("html", "text").collect()
    assert len(rows) > 1000
    assert all("".join(r["text"].split()) == "".join(_article_text(r["html"]).split()) for r in rows)


def test_counts_of_subtrees_agree_with_brute_force(spark):
    """Pages per (host, words) of plain blocks, and per named slot, counted by hand."""
    rows, words, places = [], Counter(), Counter()
    for i in range(12):
        lines = {f"line {i % 3}", f"own {i}"}
        slot = "ad" if i % 2 else "tip"
        blocks = "".join(f"<p>{line}</p>" for line in sorted(lines))
        rows.append((i, f"https://H.example:80/{i}", f"<body>{blocks}<div class='{slot}'>say {i}</div><article><p>a {i}</p></article>"))
        words.update(lines)
        places[slot] += 1
    rows += [(50, rows[0][1], rows[0][2]), (51, None, None), (52, "x", "")]
    frame = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    counts = site_templates.subtree_counts(frame, "url", "html").where("host = 'h.example'").collect()
    by_kind = {k: sorted(r["n"] for r in counts if r["kind"] == k and r["key"] is not None) for k in (0, 1, 2)}
    # (The article itself, and the paragraph that is all of it, are subtrees too.)
    assert by_kind[2] == sorted(places.values())
    assert Counter(by_kind[0])[4] == sum(n == 4 for n in words.values()) and {r["n"] for r in counts if r["key"] is None} == {12}
    assert site_templates.extract_text(frame.limit(0)).count() == 0
    assert sorted(r["text"] for r in site_templates.extract_text(frame).where("page_id > 50").collect()) == ["", ""]


def test_personal_data():
    text = "a.b@c.de, 10.0.0.256 10.0.0.25 4845 1681-1440 7329 +1 (017) 555-7713 x@y@z.com"
    found = [(pii_crf.KINDS[k], text[s:e]) for k, s, e in pii_crf.base_spans(text)]
    assert found == [("email", "a.b@c.de"), ("email", "y@z.com"), ("ip", "10.0.0.25"), ("phone", "+1 (017) 555-7713")]
    assert pii_crf.base_spans("a" * 300_000 + "1." * 3 + "a" * 300_000 + "." * 100_000) == []


def test_field_carries_an_entity_to_its_other_forms(spark):
    rows = [(i, f"call +49 30 1234{i}67 or +4930-5551{i:03d}-77 now", "a") for i in range(60)]
    model = pii_crf.train(docs(spark, rows))
    text = "call +4930-5551001-77 now and again 4930-5551001-77 please"
    added = pii_crf.added_spans(text, pii_crf.base_spans(text), model)
    assert [text[s:e] for _, s, e in added] in ([], ["4930-5551001-77"])
    assert all(s >= 22 for _, s, _ in added)


def test_links_join_forms_of_one_entity():
    text = ("+34 612 345 678 then 2024 pages, 0034612345678 and 612 345 678, host ip-10-0-0-25 is 10.0.0.25; "
            "Ann.Lee@x.org wrote ann.lee@[10] in 2024, 987 612 345 679")
    graph = pii_crf.Graph(text, pii_crf.base_spans(text))
    words = [text[s:e] for s, e in graph.tokens]
    assert {(words[i], words[j]) for i, j in graph.skip} == {
        *((word, "0034612345678") for word in ("+34", "612", "345", "678")),
        *(("0034612345678", word) for word in ("612", "345", "678,")),
        ("ip-10-0-0-25", "10.0.0.25;"), ("Ann.Lee@x.org", "ann.lee@[10]"),
    }
    assert [words[i] for i in np.flatnonzero(~graph.known)] == [
        "0034612345678", "612", "345", "678,", "ip-10-0-0-25", "ann.lee@[10]"]
    assert all(graph.labels[i] == graph.labels[j] for i, j in graph.chain)
    many = " ".join(["0034 612 345 678;"] * 20_000)
    assert len(pii_crf.Graph(many, []).skip) == 4 * 19_999


def _planted(spark):
    """Documents where entities met twice in base forms teach what their other forms are."""
    rows = []
    for i in range(80):
        phone, card, ip = f"{600000000 + 7919 * i}", "4111111111111111", f"10.{i}.7.{i + 9}"
        rows.append((i, f"call +34 {phone[:3]} {phone[3:6]} {phone[6:]} or +34{phone} in {1900 + i}. Pay with {card} or 4111 1111 "
                        f"1111 1111 by {i} May. There were {i + 100} {i + 300} {i + 500} rows. Host {ip} and again {ip} has {i * 37} files. Write m{i}.x@a.org, m{i}.x@b.org.", "a"))
    return docs(spark, rows)


def test_field_adds_the_other_forms_of_what_patterns_found(spark):
    model = pii_crf.train(_planted(spark))
    text = ("Ring +34 655 123 987 in 2024, that is 655 123 987 or 0034655123987. Card 4111-1111-1111-1111, kept as "
            "4111.1111.1111.1111 here. At 10.3.7.12 the name is ip-10-3-7-12 with 2024 files and 655 123 988 rows.")
    base = pii_crf.base_spans(text)
    assert [text[s:e] for _, s, e in base] == ["10.3.7.12", "4111-1111-1111-1111", "+34 655 123 987"]
    added = [(pii_crf.KINDS[k], text[s:e].rstrip(",.")) for k, s, e in pii_crf.added_spans(text, base, model)]
    assert sorted(added) == [
        ("card", "4111.1111.1111.1111"), ("ip", "ip-10-3-7-12"), ("phone", "0034655123987"), ("phone", "655 123 987"),
    ]
    unlinked = "In 2024 655 123 987 rows and 0034655123987 bytes on ip-10-3-7-12 or 4111.1111.1111.1111."
    assert pii_crf.added_spans(unlinked, pii_crf.base_spans(unlinked), model) == []
    long = text + " filler" * 100_000 + " again 655 123 987."
    assert [long[s:e] for _, s, e in pii_crf.added_spans(long, pii_crf.base_spans(long), model)][-1] == "655 123 987."


def test_messages_agree_with_all_labelings(spark, monkeypatch):
    """On a forest, belief propagation is exact: every labelling summed one by one."""
    model = pii_crf.train(_planted(spark))
    monkeypatch.setattr(pii_crf, "ROUNDS", 60)
    text = "655123987 and 0655123987 then 77 5 at 10.3.7.12 or ip-10-3-7-12"
    graph = pii_crf.Graph(text, pii_crf.base_spans(text))
    assert (len(graph.skip), len(graph.chain)) == (2, 1)
    n = len(graph.tokens)
    node = model["node"][np.array(graph.features)].sum(axis=1) + model["prior"]
    seen = graph.labels.tolist().index(2)
    node[seen] = -pii_crf.OBSERVED
    node[seen, 2] = 0
    want = np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=n):
        score = sum(node[i, a] for i, a in enumerate(labels))
        score += sum(model["chain"][labels[i], labels[j]] for i, j in graph.chain)
        score += sum(model["skip"][labels[i], labels[j]] for i, j in graph.skip)
        for i, a in enumerate(labels):
            want[i, a] += math.exp(score)
    got = [pii_crf._posteriors(graph, model)]
    monkeypatch.setattr(pii_crf, "EDGE_BLOCK", 2)
    got.append(pii_crf._posteriors(graph, model))
    for one in got:
        assert np.allclose(one, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    spec, library = bpe_lexicon.read_vocabulary(path), Tokenizer.from_file(path)
    texts = [t for _, t, _ in AWKWARD] + ["ΑΣ ΟΔΟΣ it's <|endoftext|>'ll É é 中文", "Z" * 3000]
    frame = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    lexicon = bpe_lexicon.build_lexicon(bpe_lexicon.frequent_words(frame, "text", spec), spec)
    for row in bpe_lexicon.decode(bpe_lexicon.encode(frame, spec, lexicon), spec).collect():
        want = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == want and row["decoded"] == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("size", [0, 5, 2_000])
def test_words_in_and_outside_the_automaton_are_encoded_alike(spark, monkeypatch, size):
    path = public_tokenizers.path("word_bpe_49k.json")
    spec, library = bpe_lexicon.read_vocabulary(path), Tokenizer.from_file(path)
    random = np.random.default_rng(size)
    letters = list("aabcdeeénoßİΣσ中'’.,!1٣ \n\t") + ["  ", "<|endoftext|>", "ing", "tion", "\u0301"]
    texts = ["".join(random.choice(letters, random.integers(0, 60))) for _ in range(400)] + ["", " ", "x" * 700]
    frame = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    lexicon = bpe_lexicon.build_lexicon(bpe_lexicon.frequent_words(frame, "text", spec, size=size, min_count=1), spec)
    encoder = bpe_lexicon.Encoder(bpe_lexicon.Vocabulary(spec), bpe_lexicon.Lexicon(lexicon))
    ids = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        got = ids.values[ids.starts[i] : ids.starts[i] + ids.lengths[i]].tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text
    assert (encoder.answered > 0) == (size > 0)


def test_long_texts_are_encoded_in_parts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    spec, library = bpe_lexicon.read_vocabulary(path), Tokenizer.from_file(path)
    text = "Héllo wörld, and  so on.\n" * 300_000
    frame = docs(spark, [(1, text, "a"), (2, "x" * 5_000_000, "a"), (3, "short", "a"), (4, " " * 5_000_000, "a")])
    got = {r["doc_id"]: r["ids"] for r in bpe_lexicon.encode(frame, spec, bpe_lexicon.build_lexicon([], spec)).collect()}
    assert got[1] == library.encode(text, add_special_tokens=False).ids
    assert got[3] == library.encode("short", add_special_tokens=False).ids and got[4] == []
    assert got[2] == library.encode("x" * 5_000_000, add_special_tokens=False).ids


def test_columns_that_encoding_makes_are_replaced(spark):
    spec = bpe_lexicon.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    frame = spark.createDataFrame([(1, "a b", "x", 5), (1, "a b", "x", 5), (None, None, None, None)],
                                  "doc_id BIGINT, text STRING, decoded STRING, IDS INT")
    both = bpe_lexicon.decode(bpe_lexicon.encode(frame, spec, bpe_lexicon.build_lexicon(["a"], spec)), spec)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    assert [tuple(r)[3] for r in both.collect()] == ["a</w> b</w>", "a</w> b</w>", ""]
    at_once = bpe_lexicon.encode(frame, spec, bpe_lexicon.build_lexicon(["a"], spec), decoded_col="decoded", keep_text=False)
    assert at_once.columns == ["doc_id", "ids", "decoded"]
    assert sorted(map(str, at_once.collect())) == sorted(map(str, both.select("doc_id", "ids", "decoded").collect()))
    odd = spark.createDataFrame([([0, -1, 10**6, 49407],), (None,), ([],)], "ids ARRAY<INT>")
    assert [r["decoded"] for r in bpe_lexicon.decode(odd, spec).collect()] == ["! <|endoftext|>", "", ""]
    nothing = bpe_lexicon.decode(bpe_lexicon.encode(frame.limit(0), spec, bpe_lexicon.build_lexicon([], spec)), spec)
    assert nothing.count() == 0


def test_ties_do_not_empty_the_frequent_words(spark):
    counts = spark.range(30_000).selectExpr("concat('w', id) AS word", "IF(id < 10, 9, 3) AS n")
    found = most_frequent(counts, 5_000)
    assert 4_900 <= len(found) <= 5_000 and [n for _, n in found[:10]] == [9] * 10
    assert len(most_frequent(counts, 10)) == 10 and most_frequent(counts.limit(0), 10) == []


def test_lexicon_is_minimal_and_exact():
    entries = {w.encode(): (i, i + 1) for i, w in enumerate(["walking", "talking", "talk", "walk", "é", "balking"])}
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon(entries))
    assert {w: lexicon.get(w) for w in entries} == entries
    assert lexicon.get(b"wal") is None and lexicon.get(b"walkings") is None and lexicon.get(b"") is None
    assert len(lexicon._final) < 24  # nodes of a tree that shares no suffixes


def test_tokens_are_allocated_by_the_rule():
    starts, lengths = np.array([0, 4]), np.array([3, 5])
    assert [allocate(starts, lengths, r)[0].tolist() for r in ("first", "last", "largest")] == [[0, 0], [0, 1], [0, 1]]


def test_token_counts_cover_every_token(spark):
    ranks = bpe_lexicon.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = [(1, "día uno\n\n\ntwo\n", "a"), (2, None, "a"), (3, "中文\nx", "a")]
    got = token_counts(docs(spark, rows), ranks, public_tokenizers.PATTERN).orderBy("doc_id", "section").collect()
    assert [(r["start"], r["end"]) for r in got if r["doc_id"] == 1] == [(0, 8), (8, 9), (9, 10), (10, 14)]
    assert [(r["start"], r["end"], r["n_tokens"]) for r in got if r["doc_id"] == 2] == [(0, 0, 0)]


@pytest.mark.parametrize("rule", RULES)
def test_sections_agree_with_brute_force(spark, rule):
    """Every code point's section and every token's bytes one by one, in sections that cut tokens."""
    ranks = bpe_lexicon.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding, lengths = _encoding(ranks, public_tokenizers.PATTERN)
    draw = random.Random(5)
    texts = ["".join(draw.choice(["One. ", "two! ", "a", " the", ".  ", "\n", "día", "中文", "? ", "🙂"])
                     for _ in range(draw.randrange(60))) for _ in range(60)]
    texts += ["Sentence of words. " * 3000, ". ", None, texts[0]]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    border = re.compile(SENTENCE_END)
    want, crossed = [], 0
    for i, text in enumerate(t or "" for t in texts):
        cuts = [0, *(m.end() for m in border.finditer(text) if m.end() < len(text)), len(text)]
        section_of = [sum(c <= at for c in cuts[1:-1]) for at in range(len(text))] if len(text) < 1000 else \
            [k for k, (a, b) in enumerate(zip(cuts, cuts[1:])) for _ in range(a, b)]
        of_byte = [section_of[at] for at, sign in enumerate(text) for _ in sign.encode()]
        tokens, across, at = Counter(), Counter(), 0
        for token in encoding.encode_ordinary(text):
            own = of_byte[at : at + int(lengths[token])]
            at += int(lengths[token])
            chosen = {"first": own[0], "last": own[-1], "largest": max(dict.fromkeys(own), key=own.count)}[rule]
            tokens[chosen] += 1
            across[chosen] += own[0] != own[-1]
        assert at == len(of_byte)
        crossed += sum(across.values())
        want += [(i, k, a, b, tokens[k], across[k]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    found = token_counts(docs(spark, rows), ranks, public_tokenizers.PATTERN, border=SENTENCE_END, rule=rule).collect()
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert crossed > 1000
    assert token_counts(docs(spark, []), ranks, public_tokenizers.PATTERN, rule=rule).count() == 0


def test_likelihood_is_exact_and_counts_are_right(spark):
    model = hidden_markov.Model.random(3)
    text = np.array([1, 5, 1030, hidden_markov._END])
    total = 0.0
    for path in np.ndindex(*[hidden_markov.STATES] * 4):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for t in (1, 2, 3):
            p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
        total += p
    assert math.isclose(hidden_markov.log_likelihoods(model, [text])[0], math.log10(total), rel_tol=1e-9)
    got = hidden_markov.score_texts(docs(spark, AWKWARD), rounds=1).collect()
    counts = Counter()
    for i, t, _ in AWKWARD:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*(t or "").lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").lower().split(), None]), 5)
                  for _, t, _ in AWKWARD)
    assert sorted(round(r["base_score"], 5) for r in got) == want
    assert hidden_markov.score_texts(docs(spark, []), rounds=1).count() == 0


def test_every_round_counts_over_all_training_documents(spark):
    chance = np.random.default_rng(4)
    texts = [np.append(chance.integers(0, 40, n % 30) + 40 * (n % 3), hidden_markov._END) for n in range(300)]
    model = hidden_markov.Model.random()
    for _ in range(3):
        model = hidden_markov.Model.from_counts(hidden_markov.expected_counts(model, texts))
    rows = [(i, False, t.astype(np.uint16).tobytes()) for i, t in enumerate(texts)] + [(-1, True, b"\x05\x00" * 50)]
    coded = spark.createDataFrame(rows, "row BIGINT, held_out BOOLEAN, classes BINARY").repartition(5)
    told = []
    got = hidden_markov.train(coded, len(texts), rounds=3, told=told)
    for part, want in zip((got.start, got.move, got.emit), (model.start, model.move, model.emit), strict=True):
        assert np.allclose(part, want, rtol=1e-4)
    assert len(told) == 3 and told == sorted(told)
    assert len(hidden_markov.Model.random().single().emit) == hidden_markov.CLASSES
    hidden_markov.train(coded, len(texts), rounds=9, least_gain=0.9, told=(few := []))
    assert len(few) == 2


def test_counts_agree_with_all_paths_and_do_not_depend_on_blocks(monkeypatch):
    """Expected counts against a sum over every path of states, and long texts in blocks of steps."""
    model = hidden_markov.Model.random(7)
    texts = [np.array([3, 9, 3, hidden_markov._END], np.uint16), np.array([hidden_markov._END], np.uint16)]
    emit, move = np.zeros_like(model.emit), np.zeros_like(model.move)
    for text in texts:
        weights = {}
        for path in np.ndindex(*[hidden_markov.STATES] * len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
            weights[path] = p
        total = sum(weights.values())
        for path, p in weights.items():
            share = p / total
            for t, state in enumerate(path):
                emit[text[t], state] += share
                if t:
                    move[path[t - 1], state] += share
    flat = hidden_markov.expected_counts(model, texts)
    _, got_move, got_emit, _ = hidden_markov._parts(flat)
    assert np.allclose(got_emit, emit) and np.allclose(got_move, move)

    chance = np.random.default_rng(1)
    texts = [np.append(chance.integers(0, 50, n), hidden_markov._END).astype(np.uint16) for n in (700, 3, 40, 1, 90)]
    whole = hidden_markov.expected_counts(model, texts), hidden_markov.log_likelihoods(model, texts)
    monkeypatch.setattr(hidden_markov, "_TOKENS_AT_ONCE", 37)
    monkeypatch.setattr(hidden_markov, "_CELLS", 400)
    parts = hidden_markov.expected_counts(model, texts), hidden_markov.log_likelihoods(model, texts)
    for one, other in zip(whole, parts, strict=True):
        assert np.allclose(one, other)


def test_quality_of_held_out_documents(spark):
    rows = [(i, (PROSE + f" end{i}. ") if i % 3 else "%%% ### " * 30 + str(i), "a") for i in range(240)]
    frame = docs(spark, [*rows, (900, None, "a"), (901, "", "a")])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i, _, _ in rows] + [(900, None, None)],
                                   "doc_id BIGINT, quality INT, toxic INT")
    scored = mil_quality.score(frame, mil_quality.train(frame, labels)).collect()
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in scored if r["doc_id"] < 240)
    assert mil_quality.train(frame, labels.limit(0)) is None
