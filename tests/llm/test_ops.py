"""Operators against plain versions, over the smallest tables and over made-up edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curaspark.llm import arrays, chat, components, decontamination, mixing, near_duplicates, pii, quality, queries, shared, substrings, tokens, toxicity, urls
from tests.compare import assert_same, views

from . import brute

EDGE = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "the same words again and again in the very same order here"),
    (6, "the same words again and again in the very same order here"),
    (6, "the same words again and again in the very same order here"),
    (None, "a text without an id"),
    (7, "x" * 5000),
    (8, "word " * 3000),
    (9, "é日本🎉 <|endoftext|> 'tis can't\u00a0stop\n\n  end "),
]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    if name == "op7_substring_dedup":
        pytest.skip("held against the plain version below; the SQL takes long")
    assert_same(queries.QUERIES[name](spark, data).toPandas(), views(data).sql(queries.ORACLES[name]).fetchdf())


def test_query_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("op", ["pii", "mix", "url", "leak", "near", "count", "substr", "tox", "quality", "chat"])
def test_empty_tables(spark, frame, tables, op):
    none, labels = frame([]), tables("labels").limit(0)
    import public_tokenizers

    run = {
        "url": lambda: urls.judge(tables("pages").limit(0)), "chat": lambda: chat.digests(chat.format_conversations(tables("conversations").limit(0).withColumn("parts", chat.text_parts(F.col("text"))))),
        "pii": lambda: pii.detect(none), "mix": lambda: mixing.mix(none), "leak": lambda: decontamination.judge(none, tables("benchmark").limit(0)), "near": lambda: near_duplicates.judge(none),
        "count": lambda: tokens.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")), "substr": lambda: substrings.judge(none), "tox": lambda: toxicity.judge(none, labels), "quality": lambda: quality.judge(none, labels),
    }
    assert run[op]().count() == 0


# 1


def _pii_case(text):
    return brute.pii(text)


def test_pii_base(spark, tables, texts):
    for r in pii.detect(tables("documents")).collect():
        n, sha = brute.pii(texts[r.doc_id])
        assert (n["email"], n["ip"], n["card"], n["phone"], sha) == (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)


PII_CASES = [
    "a@b.c+d@e.f x@y a.b@c-d.e.f@g.h", "1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110000 1", "+1 (017) 555-7713 +12 +1234567890123456 +1 2 3 4 5 6 7 8 ) (", "é🎉a@b.co 🎉1.1.1.1",
    "@@@ a@ @b.c a@.b", "+" * 50 + "1" * 50, "a" * 2000, "a." * 3000 + "@b.c", "1" * 3000, *[t for _, t in EDGE],
]


def test_pii_edge_cases(frame):
    got = {r.doc_id: r for r in pii.detect(frame(list(enumerate(PII_CASES)))).collect()}
    for i, t in enumerate(PII_CASES):
        n, sha = brute.pii(t)
        r = got[i]
        assert (n["email"], n["ip"], n["card"], n["phone"], sha) == (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256), t


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text("a1.@+- ()é🎉5", max_size=60), min_size=150, max_size=150))
def test_pii_any_text(frame, cases):
    got = {r.doc_id: r.base_sha256 for r in pii.detect(frame(list(enumerate(cases)))).collect()}
    assert [got[i] for i in range(len(cases))] == [brute.pii(t)[1] for t in cases]


def test_terms_that_disclose_an_entity(frame):
    rows = [(i, f"filler{i} words stand here codename zanzibar bob@corp.com and more{i} text follows {i}") for i in range(5)]
    rows += [(10 + i, f"plain text number{i} with codename but nothing else to say") for i in range(200)]
    found = {r.doc_id: r for r in pii.detect(frame(rows)).collect()}
    assert all(found[i].n_term >= 1 and "term:" in found[i].spans for i in range(5)) and all(found[10 + i].n_term == 0 for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(rows)).collect()}
    assert "zanzibar" not in clean[0] and "bob@corp.com" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == rows[5][1]


def test_terms_of_copied_texts(frame):
    texts = [f"filler words stand here codename zanzibar bob@corp.com and some{'abcde'[i]} text; later zanzibar bob@corp.com ends" for i in range(5)]
    rows = [(100 * i + j, t) for i, t in enumerate(texts) for j in range(20)] + [(1000 + i, f"plain text number{i} with codename but nothing else to say") for i in range(400)]
    found = pii.detect(frame(rows)).collect()
    assert all(r.n_term >= 2 if r.doc_id < 1000 else r.n_term == 0 for r in found)
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(rows)).collect()}
    assert all("zanzibar" not in clean[100 * i + j] for i in range(5) for j in range(20)) and clean[1000] == rows[100][1]


def test_terms_at_the_ends_of_a_text(frame):
    some = ["apple", "berry", "cherry", "damson", "elder"]
    rows = [(i, f"Zanzibar bob@corp.com wrote {x}") for i, x in enumerate(some)] + [(10 + i, f"{x} told ann@corp.com Quorbidle") for i, x in enumerate(some)]
    rows += [(20 + i, f"x{i}@corp.com,Wexford;joe@corp.com has the {x} " + "and nothing else of any length to speak of here") for i, x in enumerate(some)]
    rows += [(100 + i, f"plain text number{i} wrote told with nothing else to say") for i in range(200)]
    found = {r.doc_id: r for r in pii.detect(frame(rows)).collect()}
    assert all("term:0:8" in found[i].spans for i in range(5)) and all(f"term:{len(t) - 9}:{len(t)}" in found[i].spans for i, t in rows[5:10])
    assert all("term:12:19" in found[20 + i].spans for i in range(5)) and all(found[100 + i].n_term == 0 for i in range(200))


def test_sanitise_keeps_rows_and_columns(frame):
    df = frame(EDGE)
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.schema == df.schema.__class__(out.schema.fields)
    assert sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(str, EDGE))


def test_very_many_matches_in_one_text(frame):
    text = " ".join(f"é u{i}@x.org" for i in range(30_000))  # about 400,000 characters
    r = pii.detect(frame([(1, text)])).first()
    assert r.n_email == 30_000 and r.base_sha256 == brute.pii(text)[1]
    assert pii.sanitise(frame([(1, text)])).first().text == " ".join(["é [EMAIL]"] * 30_000)


def test_term_spans_against_a_plain_version(frame):
    rnd = random.Random(12)
    vocab, names, rows = [f"word{a}{b}" for a in "abcdefgh" for b in "klmno"], ("secretalpha", "secretbeta", "secretgamma"), []
    for i in range(300):
        w = [rnd.choice(vocab) for _ in range(12)]
        if i % 10 < 3:
            w[5:7] = [names[i % 10], f"id{i % 10}@corp.org"]
        elif i % 40 == 5:
            w[5] = "Secretbeta"
        rows.append((i, " ".join(w)))
    want = brute.disclosing_terms([t for _, t in rows])
    assert set(names) <= want
    for r in pii.detect(frame(rows)).collect():
        text = rows[r.doc_id][1]
        terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W_]+", text) if m.group().lower() in want]
        assert [s for s in r.spans.split(",") if s.startswith("term")] == terms


def test_overlapping_spans_are_cut_once(frame):
    out = pii.sanitise(frame([(1, "call +1.2.3.4 55 667788 or x@1.2.3.4 end")])).first().text
    assert out.startswith("call [") and out.endswith(" end") and "667788" not in out


# 2


def test_mix_reaches_targets_and_repeats(spark, frame):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 700])) for i in range(300)] + [(None, "no id"), (5, "again"), (5, "again")]
    source = [rnd.choice(["a", "a", "a", "b", "z", None]) for _ in rows]
    got = mixing.take(frame(rows, source).select("doc_id", "source", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("size"))).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = brute.targets(sizes)
    for s, t in want.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 1 and all(abs(r.target - t) < 1e-6 for r in got if r.source == s)
    assert all(r.taken <= 2 * r["size"] and sum(x.n for x in r.slots or []) == r.taken for r in got)
    line, first = {}, {}
    for r in sorted(got, key=lambda r: (hashlib.sha256((f"mix:{r.doc_id}" if r.doc_id is not None else "mix").encode()).hexdigest(), r.doc_id or 0, r.rid)):
        first[r.rid] = line.get(r.source, 0)
        line[r.source] = first[r.rid] + r["size"]
    plan = brute.schedule(want, 512)
    for r in got:
        places = [(slot, max(a, first[r.rid]) - first[r.rid], min(b, first[r.rid] + r["size"]) - max(a, first[r.rid])) for slot, a, b in brute.pieces(plan.get(r.source, []), round(want[r.source]), sizes[r.source], 512) if max(a, first[r.rid]) < min(b, first[r.rid] + r["size"])]
        assert sorted(places) == [(x.slot, x.first, x.n) for x in r.slots or []]
    again = mixing.mix(frame(rows, source)).collect()
    assert sorted(str((r.doc_id, r.taken)) for r in again) == sorted(str((r.doc_id, r.taken)) for r in got)


def test_schedule_is_even(spark):
    plan = spark.createDataFrame([("a", 1, 3000.0, 0.0, 0.5, 1), ("b", 1, 2000.0, 0.5, 1 / 2 + 1 / 3, 2), ("c", 1, 1000.0, 5 / 6, 1.0, 3)], "source string, source_size long, target double, lo double, hi double, sid int")
    rows = mixing.schedule(plan, 6000, mixing.MixParams(block=1, chunk=100)).orderBy("slot").collect()
    seen = {1: 0, 2: 0, 3: 0}
    for k, r in enumerate(rows[:6000], 1):
        assert r["rank"] == seen[r.sid]
        seen[r.sid] += 1
        assert all(abs(seen[s] - k * w) < 12 for s, w in ((1, 1 / 2), (2, 1 / 3), (3, 1 / 6)))


# 3


def test_urls(spark):
    cases = ["http://a.example.com/en/7x?q#f", "HTTPS://EXAMPLE.COM/en/1", "x://com/en/", "ftp://org#a", "nothing", None, "", "http://notexample.com/en/7", "http://u@NET/de/8/http://x", "http://example.net/de/81", "a://?b", "http://É.org/es/"]
    df = spark.createDataFrame([(i, u, "<p>", "x") for i, u in enumerate(cases)], "page_id bigint, url string, html string, host string")
    for r in urls.judge(df).collect():
        host, path = brute.split_url(cases[r.page_id])
        rule = brute.url_rule(host, path, urls.GIVEN_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1]) and r.verdict == (rule[0] if rule else "allow"), cases[r.page_id]


def test_rules_mined_from_contents(spark):
    rows = [(i, f"http://{'m.' if i % 2 else ''}host{i % 5}.info/{'es' if i % 6 == 0 else 'en'}/{i}", None if i % 50 == 0 else f'<!DOCTYPE html>\n<HTML class="x" Lang={"es-MX" if i % 6 == 0 else "en"}>') for i in range(300)]
    rows += [rows[6]] * 3 + [(1000, "http://host1.info/es/1", None), (1001, None, None), (None, "http://host1.info/es/2", "<html lang='en'>"), (1002, "x://host1.info/fr/1" + "/y" * 3000, "")]
    df = spark.createDataFrame([(*r, "t", "k") for r in rows], "page_id bigint, url string, html string, tokens string, key string")
    got = urls.judge(df, params=urls.MiningParams(min_support=0.02)).collect()
    assert len(got) == len(rows) and {r.page_id: r.verdict for r in got} == {i: "block" if u and "/es/" in u else "allow" for i, u, _ in rows}
    assert urls.judge(df.limit(0)).count() == 0 and all(r.verdict == "allow" for r in urls.judge(df.withColumn("html", F.lit(None).cast("string"))).collect())


def test_mined_rules_block_what_is_like_the_labelled(spark):
    rows = [(i, f"http://{'cheap-pills' if i % 4 == 0 else 'good'}.shop{i % 7}.info/{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    host, path = urls.split_url(F.col("url"))
    labelled = df.filter("page_id < 200").select(urls.tokens(host, path).alias("tokens"), (F.col("page_id") % 4 == 0).alias("blocked"))
    got = {r.page_id: r.verdict for r in urls.judge(df, labelled=labelled, params=urls.MiningParams(min_support=0.05)).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(400))
    rules = urls.mine(labelled, urls.MiningParams(min_support=0.05)).collect()
    assert all(not (set(a.antecedent) < set(b.antecedent) and a.verdict == b.verdict and a.confidence >= b.confidence) for a in rules for b in rules)


# 4


def test_leaks(spark, frame):
    items = [("10", "a b c d e f g h i j k"), ("9", "Short ITEM, here"), ("8", ""), ("7", None), (None, "a b c d e f g h i j"), (None, "nobody OWNS this"), ("6", "dup dup dup dup dup dup dup dup dup dup"), ("6", "other text")]
    docs = [*EDGE, (20, "x A-b C d e f; g h I j k y"), (21, "short item"), (22, "the short item HERE. short item here"), (23, "dup " * 15), (24, "b c d e f g h i j"), (25, "other text a b c d e f g h i j"), (26, "nobody owns this")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    plain = {str(k): v for k, v in items if k and k != "6"}
    more = [("6", items[6][1]), ("6", items[7][1]), ("", items[4][1]), ("", items[5][1])]
    for size in (1 << 24, 1):
        got = decontamination.judge(frame(docs), bench, decontamination.LeakParams(block_bytes=size)).collect()
        assert len(got) == len(docs)
        for r in got:
            text = next(t for i, t in docs if i == r.doc_id)
            want = brute.contamination({0: text}, plain)[0]
            ids = sorted({*want[2], *(x for k, v in more for x in brute.contamination({0: text}, {k: v})[0][2])})
            assert (r.n_words, r.n_items, r.items_sha256) == (want[0], len(ids), brute.sha(",".join(ids))), (r, text)
    kept = decontamination.drop_contaminated(frame(docs), bench)
    assert kept.columns == frame(docs).columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {20, 22, 23, 25, 26}


# 5


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, tables, texts, n, percent):
    want = brute.near_duplicates(texts, n, percent)
    got = near_duplicates.judge(tables("documents"), near_duplicates.NearParams(shingle=n, percent=percent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_of_edited_copies(spark, frame):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(400 + i, rows[7][1].upper()) for i in range(40)] + [(i, t) for i, t in EDGE if i is not None and i < 5]
    rows = [(i if i >= 10 else i + 1000, t) for i, t in rows]
    want = brute.near_duplicates(dict(rows), 3, 85)
    params = near_duplicates.NearParams(shingle=3, percent=85, block_rows=64, centres=1)
    got = near_duplicates.judge(frame(rows), params).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_keep_one_keeps_columns_and_odd_rows(frame):
    out = near_duplicates.keep_one(frame(EDGE))
    assert out.columns == frame(EDGE).columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 2, 3, 4, 5, None, 7, 8, 9]))


def test_keep_one_of_repeated_and_null_ids(frame):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (5, c), (None, c), (3, d), (4, d), (4, a), (4, "quite another text that is like none of the rest"), (6, ""), (6, ""), (7, None)]
    got = near_duplicates.keep_one(frame(rows)).collect()
    want = [(1, a), (None, b), (5, c), (3, d), (4, rows[11][1]), (6, ""), (7, None)]
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, want))


def shuffled(spark, group, run):
    """Bytes that the jobs of ``run`` write to shuffles, when joins are not broadcast by size."""
    context, was = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if tracker.getStageInfo(s) is not None)


def test_rows_that_stay_are_not_shuffled_to_drop_others(spark, frame):
    rnd = random.Random(11)
    rows = [(i, " ".join(f"{rnd.randrange(16**8):08x}" for _ in range(600))) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(4)] + [rows[9]]
    out = near_duplicates.keep_one(frame(rows))
    got = []
    moved = shuffled(spark, "keep_one", lambda: got.extend(out.collect()))
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows[:150])
    assert moved < 0.25 * sum(len(t) for _, t in rows)


def test_likely_rows_lose_none_that_is_wanted(spark):
    rows = spark.range(20000).withColumn("h", F.xxhash64("id"))
    wanted = rows.filter("id % 100 = 3").select(F.col("h").alias("w"))
    got = {r.id for r in shared.likely(rows, F.col("h"), wanted, F.col("w")).collect()}
    assert {i for i in range(20000) if i % 100 == 3} <= got and len(got) < 220
    assert shared.likely(rows, F.col("h"), wanted.limit(0), F.col("w")).count() == 0
    assert shared.likely(rows, F.col("h"), rows.select(F.col("h").alias("w")), F.col("w")).count() == 20000


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(0, k) for k in range(200, 300)] + [(7, 7)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in {y for a, b in links if a != b for y in (a, b)}}


def test_links_are_contracted_in_each_task(spark):
    rnd = random.Random(2)
    order = list(range(500))
    rnd.shuffle(order)
    path = [(a, b) for a, b in zip(order[:300], order[1:300], strict=False)] + [(a, a) for a in order[:5]] + [(order[0], order[5])] * 9
    links = spark.createDataFrame(path, "a bigint, b bigint")
    least = min(order[:300])
    got = components.contract(links.coalesce(1)).collect()
    assert sorted((r.u, r.v) for r in got) == sorted((x, least) for x in order[:300] if x != least)
    for n, in_task in ((7, components.EDGES), (1, 0), (7, 0)):
        got = components.components(links.repartition(n), in_task=in_task).collect()
        assert sorted((r.node, r.component) for r in got) == sorted((x, least) for x in order[:300])
    names = spark.createDataFrame([("b", "c"), ("a", "b"), ("é", "x")], "a string, b string")
    assert {tuple(r) for r in components.components(names).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("é", "x")}


def test_odd_sketch_estimates_similarity():
    p = near_duplicates.NearParams()
    rng = np.random.default_rng(2)
    for same in (400, 450, 480):
        x = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
        y = np.concatenate([x[:same], rng.integers(0, 1 << 62, 500 - same, dtype=np.uint64)])
        s = near_duplicates.fold(near_duplicates.samples(np.concatenate([x, y]), np.array([0, 500, 1000]), p.samples), p.sketch_bits)
        flips = np.bitwise_count(s[0] ^ s[1]).sum()
        estimate = 1 + p.sketch_bits / (4 * p.samples) * np.log(1 - 2 * flips / p.sketch_bits)
        assert abs(estimate - same / (1000 - same)) < 0.12


# 6


@pytest.fixture(scope="session")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts(spark, tables, texts, library):
    path, tok = library
    for r in tokens.count_tokens(tables("documents"), path).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids))


def test_token_counts_of_odd_texts(frame, library):
    path, tok = library
    rows = [(i, t) for i, (_, t) in enumerate(EDGE)] + [(100, "<|endoftext|>" * 3 + " <|endoftext|"), (101, "'re're''s'S 's '"), (102, "a'r a'l a'll a've 'v"), (103, "\u2003 \u00a0x\u3000"), (104, "a" * 900), (105, "日本" * 400)]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(frame(rows), path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"stmdrvel ax9'\n\t.,é日🎉\u00a0\u2028Ⅷ²_-", "<|endoftext|>"]), max_size=300).map("".join), max_size=8))
def test_transducer_on_any_text(library, cases):
    import pyarrow as pa

    path, tok = library
    counter = _counter(path)
    data, off = arrays.utf8(pa.array(cases, pa.string()))
    assert counter.count(data, off).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in cases]


_COUNTER = {}


def _counter(path):
    return _COUNTER.get(path) or _COUNTER.setdefault(path, tokens.Counter(tokens.Vocabulary.load(path)))


# 7


def test_repeats(spark, tables, texts):
    want = brute.repeats(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.judge(tables("documents")).collect()} == want


def test_repeats_of_odd_texts(frame):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 9)))
    shared = " ".join(word() for _ in range(120))
    rows = [(i, " ".join(word() for _ in range(60)) + shared[rnd.randrange(40) : 400 + rnd.randrange(200)] + " ".join(word() for _ in range(60))) for i in range(60)]
    rows += [(100, "z" * 900), (101, "ab" * 400), (102, None), (103, ""), (104, shared), (105, shared), (106, "q" * 399), (107, "q" * 400), (108, shared[:399]), (109, "y" * 401)]
    want = brute.repeats(dict(rows))
    for params in (substrings.RepeatParams(batch=8), substrings.RepeatParams(hot=3), substrings.RepeatParams(hot=0, span=40)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.judge(frame(rows), params).collect()}
        assert got == want
    whole = {r.doc_id: r for r in substrings.remove(frame([*rows, (None, shared), (None, "no id")])).collect()}
    assert whole[104].kept == b"" and whole[106].n_removed == 0


def test_segments_of_one_anchor_are_not_held_in_memory():
    import tracemalloc

    import pyarrow as pa

    n, size, params = 30_000, 5_000, substrings.RepeatParams()

    def batches():
        rng = np.random.default_rng(3)
        for lo in range(0, n, size):
            # the anchor and all after it are common, but only every other segment has a whole common window
            part = [bytes(rng.integers(97, 123, 349, np.uint8)) + b"z" * (400 if i % 2 else 360) for i in range(lo, lo + size)]
            yield pa.RecordBatch.from_arrays([pa.array([7] * size, pa.int64()), pa.array(range(lo, lo + size), pa.int64()), pa.array([349] * size, pa.int32()), pa.array(part, pa.binary())], ["h", "seg", "before", "bytes"])

    tracemalloc.start()
    got = pa.Table.from_batches(list(substrings.column_runs(params)(batches()))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(got["seg"], got["b"], strict=True)) == [(i, 749) for i in range(1, n, 2)] and set(got["h"]) == {7}
    assert peak < 40 << 20  # the segments are 22 MB, two blocks 16 MB; held as objects they took more


# 8


def test_lexicon_automaton():
    a = toxicity.Automaton(["idiot", "clown", "moron", "bad", "scum"], 5)
    import pyarrow as pa

    cases = {"idiot": 1, "idi0t": 2, "idiiot": 2, "idot": 2, "idoit": 2, "iidoit": 0, "bad": 1, "bat": 0, "crown": 2, "scun": 0, "": 0, "clownsy": 0, "clowns": 2, "lown": 2, "morno": 2, "x" * 99: 0}
    data, off = arrays.utf8(pa.array(list(cases), pa.string()))
    assert dict(zip(cases, a.classify(data, off[:-1], off[1:]).tolist(), strict=True)) == cases


def test_scores(spark, frame):
    rnd = random.Random(6)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = [rnd.choice(vocab) for _ in range(60)]
        if bad:
            for _ in range(4):
                w[rnd.randrange(60)] = rnd.choice(["nastyword", "grubbel", "zorkfool"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    extra = [(2000, "you grubel and nastywrod and zorkfoll are all here today"), (2001, 'someone said "nastyword" in a talk about manners'), (2002, None), (2003, "")]
    model = toxicity.learn(frame(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert set(model.terms) == {"nastyword", "grubbel", "zorkfool"}
    got = {r.doc_id: r for r in toxicity.score(frame([*rows, *extra]), model).collect()}
    assert all(got[i].predicted == bad for i, bad in labels) and got[2000].predicted == 1 and got[2001].predicted == 0
    low = min(r.score for r in got.values())
    assert got[2002].score == got[2003].score == low and all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)


def test_scores_without_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert len({r.score for r in toxicity.judge(frame(EDGE), none).collect()}) == 1


# 9


def test_statistics(spark, tables, texts):
    rows = {r.doc_id: r for r in quality.statistics(tables("documents")).collect()}
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(texts[i]) for i, r in rows.items())


def test_statistics_of_odd_texts(frame):
    rows = [(i, t) for i, (_, t) in enumerate(EDGE)] + [(50, "a\n\na\n b\nb \n \na"), (51, "#*$%&|<> é#"), (52, " ".join(map(str, range(20)))), (53, "a b c d e f g h a b c d e f g h " + " ".join(map(str, range(50)))), (54, "x " * 7), (55, "x " * 9)]
    got = {r.doc_id: r for r in quality.statistics(frame(rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), t


def test_decision_list_learns_and_keeps_good_rows(spark, frame):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(999)}{'***' if bad else ''}" for _ in range(40))))
        labels.append((i, 0 if bad else 1))
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.judge(frame(rows), lab).collect()}
    assert all(got[i].kept == bool(q) for i, q in labels)
    out = quality.filter_quality(frame([*rows, *EDGE]), lab)
    assert out.columns == frame([]).columns and {r.doc_id for r in out.collect()} == {i for i, q in labels if q}
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert all(r.kept != r.base_failed for r in quality.judge(frame(rows[:20]), none).collect())


# 10


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>\n", "\\e\\l\\b\\", "[x]<y>\\n\n", None, "", "é日🎉", "\\"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate((r, x) for x in nasty for r in ("user", "assistant", None, "sys\nt<em"))]
    rows += [(2, None, "user", "b"), (2, None, "user", "b"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    want = {1: [(t, r or "", x or "") for c, t, r, x in rows if c == 1], 2: [(0, "user", "b"), (0, "user", "b"), (1, "assistant", "a")]}
    for c, ts in want.items():
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), brute.sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(loss), brute.sha(loss))
    assert got[None].turns_sha256 == got[1].turns_sha256
    text = out.filter("conv_id = 1").first().formatted
    assert text.count("<|turn|>") == text.count("<|end|>") == len(want[1]) and "[INST]" not in text and "</s>" not in text


def test_chat_parts(spark):
    df = spark.createDataFrame([(1, 0, "user", [("text", "see <this>", None, None), ("image", None, "a.png", 4), ("audio", None, "b.wav", 10), ("text", "!", None, None)]), (1, 1, "assistant", [("text", "ok", None, None), ("document", None, "c.pdf", None), ("hologram", None, "d", 2)])], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert "see \\lthis><|image|><|audio|>!" in r.formatted and "ok<|document|><|document|>" in r.formatted
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 1024), (0, "audio", "b.wav", 250), (1, "document", "c.pdf", 512), (1, "hologram", "d", 1024)] and r.n_expanded == 2810


def test_chat_of_very_many_turns(spark):
    n = 40_000
    df = spark.range(n).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é <x> "), F.col("id").cast("string")).alias("text"), F.lit("x").alias("ts"))
    r = chat.digests(chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))))).first()
    assert (r.n_turns, r.loss_sha256) == (n, brute.sha("".join(f"é <x> {i}" for i in range(1, n, 2))))


# the pipeline


def test_stages_of_odd_tables(spark, frame, data):
    import corpus_pipeline as P

    names = ["_t", "_row", "did", "spans", "key", "band", "th", "_class", "_rid", "_spans", "u", "v"]
    body = " ".join(f"plain{i} words{i * 7 % 31}" for i in range(60))
    rows = [*EDGE, (50, body), (50, body), (None, body), (51, body + " call +1 (017) 555-7713 or a@b.co"), (52, "other " + " ".join(f"text{i}" for i in range(80)))]
    for part in ([], rows):
        docs = frame(part)
        for k, x in enumerate(names):
            docs = docs.withColumn(x, F.lit(k))
        for name, stage in P.STAGES:
            out = stage(spark, docs, data)
            if name != "mix_sources":
                assert out.columns == docs.columns
            got = out.collect()
            assert bool(got) == bool(part), name
    assert all("a@b.co" not in (r.text or "") for r in P.personal_data(spark, docs, data).collect())

def test_pipeline(spark, data, tables):
    import corpus_pipeline as P

    docs = tables("documents")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "personal_data", "mix_sources"]
    state, seen = docs, {}
    for name, stage in P.STAGES:
        state = P.spill(stage(spark, state, data), name)
        seen[name] = state
        if name != "mix_sources":
            assert state.columns == docs.columns
    text = {k: {r.doc_id: r.text for r in v.collect()} for k, v in seen.items() if k != "mix_sources"}
    assert all(not brute.quality(t)[5] for t in text["quality_rules"].values())
    want = brute.near_duplicates(text["quality_rules"], 5, 80)
    assert set(text["near_dedup"]) == {d for d, (_, c) in want.items() if d == c}
    bench = {r.item_id: r.text for r in tables("benchmark").collect()}
    assert set(text["decontaminate"]) == {d for d, x in brute.contamination(text["near_dedup"], bench).items() if not x[1]}
    assert set(text["personal_data"]) == set(text["decontaminate"])
    for d, t in text["personal_data"].items():
        assert sum(brute.pii(t)[0].values()) == 0 and (t == text["decontaminate"][d] or sum(brute.pii(text["decontaminate"][d])[0].values()) > 0 or "[TERM]" in t or len(t) < len(text["decontaminate"][d]))
    mixed = {r.doc_id: r for r in seen["mix_sources"].collect()}
    assert set(mixed) == set(text["personal_data"]) and all(r["size"] == len(brute.WS.findall(text["personal_data"][d])) for d, r in mixed.items())
    assert {r.doc_id: r.taken for r in P.run(spark, data).collect()} == {d: r.taken for d, r in mixed.items()}
