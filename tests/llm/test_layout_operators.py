"""Line templates, shards, quotations and archives against direct statements."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from polylogue.llm import arc_warc as A
from polylogue.llm import extendible_shards as X
from polylogue.llm import line_templates as L
from polylogue.llm import quote_threads as Q
from polylogue.llm.common import Scratch
from polylogue.session import scratch_path


def test_recurring_templates_are_dropped_with_their_variables(frame, prose):
    rows = [(d, "\n".join([prose(9, d), f"Page {d} of 99", prose(7, 1000 + d), f"Posted by user{d} on 2020-01-{d:02d}", "  All rights reserved. "])) for d in range(30)]
    rows += [(100, "Page of contents here"), (101, None), (102, ""), (103, "\n\n")]
    got = {r["doc_id"]: r for r in L.without_recurring_lines(frame(rows)).collect()}
    assert len(got) == len(rows)
    for d in range(30):
        assert got[d]["text"] == prose(9, d) + "\n" + prose(7, 1000 + d) and (got[d]["n_lines"], got[d]["n_dropped"]) == (5, 3)
    assert got[100]["text"] == "Page of contents here" and got[101]["text"] == "" and got[103]["text"] == "\n\n" and got[103]["n_lines"] == 3


def test_words_that_vary_in_a_leaf_become_wildcards(frame):
    names = "anna bert cleo dora emil fred gina hans ida jan karl lea".split()
    rows = [(i, f"This letter was written for {n} today") for i, n in enumerate(names)] + [(50, "This letter was never opened or read")]
    got = L.recurring_lines(frame(rows)).collect()
    assert {r["doc_id"] for r in got} == set(range(12)) and {r["template"] for r in got} == {"This letter was written for <*> today"}


def test_line_edge_cases(frame, prose):
    assert L.without_recurring_lines(frame([])).count() == 0
    long = "\n".join(prose(5, i) for i in range(5000))
    rows = [(1, long), (1, long), (2, "x")]
    got = L.without_recurring_lines(frame(rows), min_docs=2).collect()
    assert len(got) == 3 and all(r["n_dropped"] == 0 for r in got)


def kept_lines(frame, rows, **how):
    return sorted((r["doc_id"] or 0, r["text"]) for r in L.without_recurring_lines(frame(rows), **how).collect())


def test_a_template_with_many_variable_words(frame, words):
    """Five of nine words are the template's; names and addresses vary in every line."""
    rows = [(i, f"2024-01-{i % 28 + 1:02d} 10:00:{i % 60:02d} INFO user {words[i]}{words[-i - 1]} logged in from 10.0.0.{i}") for i in range(100)]
    assert all(t == "" for _, t in kept_lines(frame, rows))


def test_two_templates_in_one_leaf(frame, words):
    rows = [(i, f"the server said {words[i]} was refused by the gate of node") for i in range(50)]
    rows += [(100 + i, f"the server said all jobs that {words[i]} has sent are lost") for i in range(50)]
    rows += [(200 + i, f"the server said {words[3 * i]} {words[3 * i + 1]} {words[3 * i + 2]} {words[i + 90]} {words[i + 120]} {words[i + 150]} {words[i + 180]} {words[i + 200]}") for i in range(20)]
    got = {r["doc_id"]: r["template"] for r in L.recurring_lines(frame(rows)).collect()}
    assert {d for d in got if d < 50} == set(range(50)) and {d for d in got if 100 <= d < 150} == set(range(100, 150)) and not {d for d in got if d >= 200}
    assert set(got.values()) == {"the server said <*> was refused by the gate of node", "the server said all jobs that <*> has sent are lost"}


def test_long_lines_need_fewer_documents(frame, prose):
    shared = {n: prose(n, 800 + n) for n in (12, 30, 60)}
    rows = [(i, f"{prose(8, i)}\n{shared[60]}") for i in range(2)] + [(10 + i, f"{prose(8, 40 + i)}\n{shared[30]}") for i in range(5)]
    rows += [(20 + i, f"{prose(8, 80 + i)}\n{shared[30][:-1]}x") for i in range(4)] + [(30 + i, f"{prose(8, 120 + i)}\n{shared[12]}") for i in range(9)]
    got = dict(kept_lines(frame, rows))
    assert all("\n" not in got[i] for i in (0, 1)) and all(got[10 + i].count("\n") == 0 for i in range(5))
    assert all(shared[12] in got[30 + i] for i in range(9))


def test_rows_with_one_id_lose_their_own_lines(frame, prose):
    common = prose(55, 7)
    rows = [(5, f"{common}\n{prose(9, 1)}"), (5, f"{prose(9, 2)}\n{prose(9, 3)}"), (6, f"{prose(9, 4)}\n{common}"), (None, common), (None, prose(9, 5)), (7, "same\n" + prose(9, 6)), (7, "same\n" + prose(9, 6))]
    assert kept_lines(frame, rows) == sorted([(5, prose(9, 1)), (5, f"{prose(9, 2)}\n{prose(9, 3)}"), (6, prose(9, 4)), (0, ""), (0, prose(9, 5)), (7, "same\n" + prose(9, 6)), (7, "same\n" + prose(9, 6))])


def test_lines_are_not_split_into_clusters_that_cannot_recur(frame):
    """Twelve lines of one leaf, three each with a word in common: enough for a template in three documents, not in ten."""
    spark = frame([]).sparkSession
    lines = ["one two three " + "wxyz"[i % 4] + "".join(f" {c}{'abcdefghijkl'[i]}" for c in "pqrs") for i in range(12)]
    distinct = spark.createDataFrame([("8 one two three", x, 8, 1) for x in lines], "path string, masked string, size int, n long")
    found = lambda least: L._clustered(distinct, Scratch(spark), L.KEEP, L.CONSTANT, L.SIMILAR, least).collect()
    assert {r["template"] for r in found(3)} == {f"one two three {w} <*> <*> <*> <*>" for w in "wxyz"}
    assert all(r["template"] == r["masked"] for r in found(None))


def plain_templates(lines):
    """Template of each distinct line (a tuple of words, masked) with its count, cluster by cluster."""
    from collections import Counter, defaultdict

    clusters, out = defaultdict(dict), {}
    for words, n in lines.items():
        clusters[(len(words), words[:L.DEPTH])][words] = n
    clusters = list(clusters.values())
    while clusters:
        cluster = clusters.pop()
        total = sum(cluster.values())
        votes = Counter()
        for words, n in cluster.items():
            for at, w in enumerate(words):
                votes[at, w] += n
        size = len(next(iter(cluster)))
        template = []
        for at in range(size):
            n, w = max((votes[at, w], w.encode()) for w in {x[at] for x in cluster})
            template.append(w.decode() if n >= L.KEEP * total else L.WILD)
        kept = sum(t != L.WILD for t in template)
        split = defaultdict(dict)
        for words, n in cluster.items():
            agree = sum(w == t != L.WILD for w, t in zip(words, template, strict=True))
            picks = [(votes[at, w], -at, w) for at, w in enumerate(words) if w != L.WILD and n < votes[at, w] < total]
            if kept >= L.CONSTANT * size and agree >= L.SIMILAR * kept:
                out[words] = " ".join(template)
            elif picks:
                split[max(picks)[1:]][words] = n
            else:
                out[words] = " ".join(words)
        clusters += split.values()
    return out


def test_templates_equal_a_plain_statement(frame):
    import random
    import re
    from collections import Counter, defaultdict

    rng = random.Random(31)
    some = "alpha beta gamma delta eps zeta eta theta 17 x9".split()
    rows = [(d, "\n".join(" ".join(["go", "to", "it"][:rng.randrange(4)] + [rng.choice(some[:rng.choice((2, 10))]) for _ in range(rng.choice((3, 3, 7)))]) for _ in range(6))) for d in range(150)]
    lines, docs = Counter(), defaultdict(set)
    for d, text in rows:
        for line in text.split("\n"):
            words = tuple(re.sub(r"[^ ]*[0-9][^ ]*", L.WILD, line).split(" "))
            lines[words] += 1
    named = plain_templates(lines)
    for d, text in rows:
        for line in text.split("\n"):
            words = tuple(re.sub(r"[^ ]*[0-9][^ ]*", L.WILD, line).split(" "))
            docs[named[words], len(words)].add(d)
    for least in (2, 6, 30):
        recur = {t for (t, _), ds in docs.items() if len(ds) >= least}
        got = {(r["doc_id"], r["line_no"], r["template"]) for r in L.recurring_lines(frame(rows), min_docs=least).collect()}
        want = {(d, i, named[w]) for d, text in rows for i, line in enumerate(text.split("\n"))
                for w in [tuple(re.sub(r"[^ ]*[0-9][^ ]*", L.WILD, line).split(" "))] if named[w] in recur}
        assert got == want


def test_lines_of_more_leaves_than_are_broadcast(frame, words, monkeypatch):
    rows = [(i, f"first {words[i % 5]} kind of line\nsecond kind of {words[i % 3]} line here") for i in range(40)]
    few = kept_lines(frame, rows)
    monkeypatch.setattr(L, "LEAVES", 0)
    assert kept_lines(frame, rows) == few


def brute_shards(rows, limit):
    bits = {d: f"{int(hashlib.md5(('' if d is None else str(d)).encode()).hexdigest()[:15], 16):060b}" for d, _ in rows}
    out = {}
    for d, _ in rows:
        for depth in range(61):
            inside = [len((t or "").encode()) for e, t in rows if bits[e][:depth] == bits[d][:depth]]
            if sum(inside) <= limit or len(inside) == 1:
                out[d] = (bits[d][:depth], depth, sum(inside) > limit)
                break
    return out


def test_shards_equal_brute_force(frame, prose):
    rows = [(d, prose(d % 40, d)) for d in range(150)] + [(500, prose(900, 1)), (501, None), (502, "")]
    got = X.extendible_shards(frame(rows), "doc_id", F.octet_length("text"), 1500).collect()
    assert {r["doc_id"]: (r["shard"], r["depth"], r["oversized"]) for r in got} == brute_shards(rows, 1500)
    assert len(got) == len(rows)


def test_a_hot_key_is_spread_by_its_rows(frame):
    rows = [(7, "x" * 100)] * 200 + [(d, "y" * 50) for d in range(100, 140)] + [(None, "z" * 10)] * 3
    got = X.extendible_shards(frame(rows), "doc_id", F.octet_length("text"), 1000).collect()
    total = {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["bytes"]
    assert len(got) == len(rows) and max(total.values()) <= 1000 and not any(r["oversized"] for r in got)


def test_shards_of_nothing_and_written_shards(spark, frame, prose):
    assert X.extendible_shards(frame([]), "doc_id", F.octet_length("text")).count() == 0
    path = scratch_path(spark, "t-shards")
    rows = [(d, prose(30, d)) for d in range(60)]
    made = X.write_shards(frame(rows), "doc_id", path, 2000).collect()
    assert sum(r["rows"] for r in made) == 60 and max(r["bytes"] for r in made) <= 2000
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(path).collect()) == rows


CONV = [
    (1, 0, "user", "Hello there.\nHow do I open the door?"),
    (1, 1, "assistant", "> How do I open the door?\nUse the key."),
    (1, 2, "user", "> Hello there.\n> How do I open the door?\nStill the first question."),
    (1, 3, "assistant", "> > How do I open the door?\n> Use the KEY.\nYes, do that."),
    (1, 4, "user", "> never said\nOk."),
    (2, 0, "user", None), (2, 5, "assistant", "> How do I open the door?\nOther conversation."), (2, 9, None, ""),
    (None, 3, "user", "x"), (3, None, "user", "> y"),
]


def test_replies_follow_their_quotations(spark):
    df = spark.createDataFrame(CONV, "conv_id long, turn long, role string, text string").withColumns({"level": F.lit(1), "hash": F.lit("h")})
    got = {(r["conv_id"], r["turn"]): r for r in Q.quote_threads(df).collect()}
    parents = {k: (r["parent_turn"], r["linked"], r["depth"]) for k, r in got.items()}
    assert parents == {(1, 0): (None, False, 0), (1, 1): (0, True, 1), (1, 2): (0, True, 1), (1, 3): (1, True, 2), (1, 4): (3, False, 3),
                       (2, 0): (None, False, 0), (2, 5): (0, False, 1), (2, 9): (5, False, 2), (None, 3): (None, False, 0), (3, None): (None, False, 0)}
    assert got[1, 3]["text"] == "Yes, do that." and got[1, 3]["quoted_lines"] == 2 and got[2, 0]["text"] == ""
    chats = {(r["conv_id"], r["block"]): r["chat"] for r in Q.chat_blocks(Q.quote_threads(df), 2).collect()}
    assert chats[1, 1] == "<|assistant|> re:1\nYes, do that.\n<|end|>\n<|user|>\nOk.\n<|end|>" and chats[1, 2] == "<|user|> re:0\nStill the first question.\n<|end|>"
    assert {k: r["place"] for k, r in got.items()} == {(1, 0): 0, (1, 1): 1, (1, 3): 2, (1, 4): 3, (1, 2): 4, (2, 0): 0, (2, 5): 1, (2, 9): 2, (None, 3): None, (3, None): None}
    assert Q.quote_threads(df.limit(0)).count() == 0


def test_quotations_equal_the_sql_statement(spark):
    import duckdb
    import pandas as pd

    rows = []
    for c in range(6):
        texts = []
        for t in range(14):
            own = f"Line {c} {t} alpha.\nSecond line, {t % 4}!"
            quoted = texts[(t * 7 + c) % t].split("\n") if t and (t + c) % 3 else []
            quoted = ["> " + x for x in quoted] if (t + c) % 5 == 0 else quoted  # all of it one level deeper
            texts.append("\n".join([*["> " + x for x in quoted], own]))
            rows.append((c, t, "user" if t % 2 else "assistant", texts[-1]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = Q.quote_threads(df).select("conv_id", "turn", "role", "parent_turn", "linked", "depth", "place", "quoted_lines", F.sha2("text", 256).alias("text_sha256"))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = con.sql(Q.ORACLE).fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert sum(r[4] for r in want) > 30


def test_the_shallowest_quotation_with_a_source_links(spark):
    rows = [(1, 0, "user", "Where is the key?"), (1, 1, "assistant", "In the box by the door."), (1, 2, "user", "Thanks."), (1, 3, "assistant", "> > Where is the key?\nStill there."),
            (1, 4, "user", "> nobody said this\n> > In the box by the door.\nNo."), (1, 5, "user", "> Thanks.\n> > Where is the key?\n> > In the box by the door.\nSure.")]
    got = Q.quote_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["turn"]: (r["parent_turn"], r["linked"]) for r in got} == {0: (None, False), 1: (0, False), 2: (1, False), 3: (0, True), 4: (1, True), 5: (2, True)}


def test_places_follow_the_replies(spark, monkeypatch):
    """Random trees, a message with many replies and a long line of replies, against a walk."""
    import random

    monkeypatch.setattr(Q, "TURN_BLOCK", 8)
    rng = random.Random(4)
    rows = []
    for c in range(5):
        turns = sorted(rng.sample(range(500), 60))
        for i, t in enumerate(turns):
            rows.append((c, t, None if i == 0 else turns[{0: 0, 1: i - 1}.get(c, rng.randrange(i))]))
    got = {(r["conv_id"], r["turn"]): r["place"] for r in Q._places(spark.createDataFrame(rows, "conv_id long, turn long, parent long")).collect()}
    for c in range(5):
        children = {}
        for _, t, p in (r for r in rows if r[0] == c):
            children.setdefault(p, []).append(t)
        order, todo = [], children[None][:]
        while todo:
            t = todo.pop()
            order.append(t)
            todo += reversed(children.get(t, []))
        assert [got[c, t] for t in order] == list(range(60))


def test_a_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), "id", F.lit("user").alias("role"), F.lit("same text").alias("text")).withColumnRenamed("id", "turn")
    got = Q.quote_threads(df).where("depth = turn").count()
    assert got == 3000


V1 = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n\n"


def test_arc_versions_are_parsed_by_their_lines():
    one = V1 + b"http://a.b/c d 1.2.3.4 19970101 text/html 9\nHTTP/1.0\n\ndns:a.b 1.2.3.4 19970101000000 text/dns 3\nabc\n"
    first, page, dns = A.parse_arc(one)
    assert first["URL"] == "filedesc://a.arc" and page["URL"] == "http://a.b/c d" and page["body"] == b"HTTP/1.0\n" and dns["body"] == b"abc"
    about = b"2 0 own\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
    two = b"filedesc://b.arc 0.0.0.0 20000101000000 text/plain 200 - - 0 b.arc %d\n" % len(about) + about + b"\nhttp://x/ 1.1.1.1 20000102030405 text/html 200 sum - 77 b.arc 5\nhel\nohttp"
    _, page, *rest = A.parse_arc(two[:-4] + b"\n")
    assert page["Result-code"] == "200" and page["Archive-length"] == "5" and page["body"] == b"hel\no" and not rest and not page["cut"]
    cut = list(A.parse_arc(V1 + b"http://a/ 1.2.3.4 19970101 text/html 100\nshort"))[-1]
    assert cut["cut"] and cut["body"] == b"short"
    for bad in (b"no version block\n", V1 + b"http://a/ too few\n"):
        with pytest.raises(ValueError):
            list(A.parse_arc(bad))


def test_equivalent_warc_fields():
    record = {"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "19970203", "Content-type": "text/html", "body": b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nhello", "cut": False}
    w = A.as_warc(record)
    assert (w["type"], w["date"], w["payload"], w["digest"]) == ("response", "1997-02-03T00:00:00Z", b"hello", base64.b32encode(hashlib.sha1(b"hello").digest()).decode())
    assert w["record_id"] == A.as_warc(record)["record_id"] and w["record_id"].startswith("urn:uuid:")
    assert A.as_warc(record | {"body": b"plain"})["type"] == "resource" and A.as_warc(record | {"URL": "filedesc://x"})["type"] == "warcinfo"


def test_pages_come_back_from_the_archives(spark):
    pages = [(i, f"http://h/{i}", None if i % 11 == 0 else f"<p>é {i % 7}</p>\r\n\r\n" * (i % 7)) for i in range(60)] + [(100, None, "WARC/1.1\r\n\r\n"), (101, "http://a b/", "x" * 3_000_000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, number long")
    got = {r["page_id"]: r for r in A.pages_through_warc(df, scratch_path(spark, "t-warc")).collect()}
    first = {}
    for i, _, h in pages:
        first.setdefault(h or "", i)
    assert len(got) == len(pages)
    for i, _, h in pages:
        data, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))


def test_archive_edge_cases(spark):
    kinds = "page_id long, url string, html string"
    assert A.pages_through_warc(spark.createDataFrame([], kinds), scratch_path(spark, "t-warc0")).count() == 0
    twice = spark.createDataFrame([(5, "u", "same"), (5, "u", "same"), (3, "v", "same"), (None, "w", "same")], kinds)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in A.pages_through_warc(twice, scratch_path(spark, "t-warc1")).collect())
    assert got == [(0, "revisit", 3), (3, "response", 0), (5, "revisit", 3), (5, "revisit", 3)]


def test_a_page_with_the_address_of_a_version_block_is_a_page(spark):
    pages = [(1, "filedesc://page.arc", "<p>one</p>"), (2, "http://h/2", "<p>two</p>"), (3, "filedesc:x", "<p>two</p>"), (4, "filedesc:y", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in A.pages_through_warc(df, scratch_path(spark, "t-warc3")).collect())
    assert got == [(1, 10, "response", 0), (2, 10, "response", 0), (3, 10, "revisit", 2), (4, 0, "response", 0)]


def test_payloads_survive_whole(spark):
    arc = V1 + b"".join(b"http://a/%d 1.2.3.4 19970101 image/png 43\nHTTP/1.0 200 OK\r\nX-Record-Number: %02d\r\n\r\n%b\n" % (i, i, b"\x00\xff\r") for i in range(3))
    path = scratch_path(spark, "t-warc2")
    A.write_warcs(A.convert(spark.createDataFrame([(gzip.compress(arc),)], "content binary")), path, 1)
    back = A.read_warcs(spark, path).collect()
    assert sorted((r["type"], r["number"], r["payload"]) for r in back if r["type"] != "warcinfo") == [
        ("response", 0, bytearray(b"\x00\xff\r")), ("revisit", 1, None), ("revisit", 2, None)] and len(back) == 4


def test_repeated_negative_and_null_numbers_keep_their_payloads(spark):
    """Rows of one id with other payloads are other records; the smallest id may be negative; a row without id refers to one with."""
    import re

    rows = [(3, "v", "same"), (5, "u", "same"), (5, "u", "other text"), (-7, "w", "minus"), (2, "x", "minus"), (None, "n", "same"), (None, "n", "only here"), (None, "m", "only here"),
            (9, "r", "twice"), (9, "r", "twice"), (0, "z", None), (-1, "z", ""), (4, "filedesc://x", "f")]
    path = scratch_path(spark, "t-warc")
    got = A.pages_through_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for i, _, t in rows:
        ids = [j for j, _, other in rows if (other or "") == (t or "") and j is not None]
        refers = min(ids) if ids and min(ids) != i else None
        want.append((i, len((t or "").encode()), digest(t), "response" if refers is None else "revisit", refers))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    # every payload is in the archives
    records = A.read_warcs(spark, path).collect()
    assert {r["payload"].decode() for r in records if r["type"] == "response"} == {t or "" for _, _, t in rows}
    ids = {r["record_id"] for r in records}
    assert all(r["refers_to_id"] in ids for r in records if r["type"] == "revisit") and all(re.fullmatch(r"urn:uuid:[0-9a-f-]{36}", i) for i in ids)
