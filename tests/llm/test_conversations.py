"""Prefix trie, conversation repair and license templates against brute force, and on odd inputs."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tidemark.llm import conversation_repair as cr
from tidemark.llm import conversation_trie as ct
from tidemark.llm import license_scan, ordered, queries

CONV = "conv_id long, turn long, role string, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def made(seed: int, convs: int, most: int) -> list[tuple]:
    """Conversations with shared openings, copies, nulls, repeated turns and rows, and one much longer than the others."""
    rng, rows = random.Random(seed), []
    for c in range(convs):
        n = most if c == 3 else rng.randint(0, 7)
        for t in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""])
            text = rng.choice(["yes.", "no", "yes.", "what is it?", None, "", " \t", "a b c.", "Ünï 𝄞!", "one. two"])
            rows.append((c, rng.choice([t, t, t, t - 1, None]), role, text))
    return rows + rows[:5] + [(None, 1, "user", "lost")]


@pytest.fixture(scope="module")
def rows():
    return made(1, 60, 230)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, CONV).repartition(3)


@pytest.fixture(scope="module")
def folder(table, tmp_path_factory):
    path = tmp_path_factory.mktemp("conversations")
    table.write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_bucket_queue_repair"])
def test_odd_rows_equal_sql(spark, folder, name):
    assert_same(queries.QUERIES[name](spark, folder).toPandas(), connect(folder).sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_bucket_queue_repair"])
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_numbered_places(spark, rows, table):
    got = ordered.numbered(table.where("conv_id is not null"), "conv_id", ["turn", "role"]).select("conv_id", "turn", "role", "__pos").collect()
    of = defaultdict(list)
    for r in got:
        of[r["conv_id"]].append(r)
    low = lambda x: (x is not None, x or 0)
    for conv, own in of.items():
        own.sort(key=lambda r: r["__pos"])
        assert [r["__pos"] for r in own] == list(range(1, len(own) + 1)), conv
        keys = [(low(r["turn"]), (r["role"] is not None, r["role"] or "")) for r in own]
        assert keys == sorted(keys)
    assert len(got) == sum(r[0] is not None for r in rows)


# --- prefix trie


def brute_trie(paths: dict[int, list]) -> set:
    """Nodes of complete paths by walking every prefix."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = set()
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaf = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * (len(SPACE.findall(x[-1][1])) if x else 0) for x in below)
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        children = sum(len(x) == len(node) + 1 for x in below)
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_without_splicing(spark):
    """Whole conversations, with one of 70 turns, copies, and conversations that end inside others."""
    rng = random.Random(4)
    paths = {c: [(rng.choice("ua"), rng.choice(["x y", "z"])) for _ in range(rng.randint(1, 5))] for c in range(-5, 40)}
    paths[41] = [("u", f"turn {i // 3}") for i in range(70)]
    paths[42], paths[43] = paths[41], paths[41][:33]
    table = spark.createDataFrame([(c, i, *t) for c, path in paths.items() for i, t in enumerate(path)], CONV)
    got = {tuple(r) for r in ct.prefix_trie(ct.turns_in_order(table)).collect()}
    assert got == brute_trie(paths)


def test_trie_names_of_columns_and_one_conversation(spark):
    table = spark.createDataFrame([(7, 0, "user", "a b", "x", 1)], "depth long, part long, words string, digest string, n_convs string, k0 long")
    got = ct.prefix_trie(ct.turns_in_order(table, "depth", "part", "words", "digest")).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in got} == {(7, 0, None, 1, 1, 1, 0, none), (7, 1, 7, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())}


def test_long_lists_of_ends(spark):
    """Equal conversations: their ids are hashed piece by piece."""
    table = spark.range(3000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    got = {r["depth"]: r for r in ct.prefix_trie(ct.turns_in_order(table)).collect()}
    assert got[1]["n_convs"] == 3000 and got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()


# --- repair


def brute_repair(letters: str, faults: list[int]) -> tuple[int, str]:
    """Least cost, then least string, by a queue of (cost, audit) over all edits, pruned by the cost alone."""
    n, best, heap, found = len(letters), {}, [(0, "", 0, 0)], []
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if found and cost > found[0][0]:
            break
        if best.setdefault((i, q), cost) < cost:
            continue
        if i == n and q in (0, 3):
            found.append((cost, audit))
            continue
        step = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}[q]
        heapq.heappush(heap, (cost + 3, audit + "I", i, step[1]))
        if i < n:
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if faults[i] not in (1, 2):
                more = 3 if faults[i] == 3 else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, step[1]))
                if letters[i] == step[0]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, step[1]))
                if letters[i] == "s" and q == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1))
    return min(found)


def test_shortest_edits():
    rng = random.Random(0)
    for _ in range(400):
        n = rng.randint(0, 7)
        letters, faults = "".join(rng.choice("suax ") for _ in range(n)), [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        dist = cr.distances(letters, bytes(faults), cr.ENDS, True)
        assert (dist[0], cr.walk(dist, letters, bytes(faults), 0, True)[0]) == brute_repair(letters, faults), (letters, faults)


def test_chunks_change_nothing(spark, table):
    whole = cr.repair(table).toPandas()
    assert_same(cr.repair(table, chunk=3).toPandas(), whole)
    assert whole["audit"].str.len().max() > 200


def test_damage_and_named_ids(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "So. Yes!"), (1, 1, None, None), (2, 5, "user", "Hi.")], CONV)
    modes = [[tuple(r) for r in cr.damaged(table, F.lit(m)).orderBy("conv_id", "turn").collect()] for m in range(6)]
    assert modes[0] == [] and modes[1][0] == (1, 0, "assistant", "") and modes[2][0] == (1, 0, "assistant", "So Yes") and modes[3][:2] == [(1, 0, "assistant", "So. Yes!")] * 2
    assert modes[4][0] == (1, 0, "user", "So. Yes!") and modes[5][1] == (1, 1, " ", " ")
    left = cr.repair(table.where("conv_id = 2"), table).orderBy("conv_id").collect()
    assert tuple(left[0]) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert tuple(left[1])[:8] == (2, 0, 0, 0, 0, 0, 3, "KI") and left[1]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()


def test_extreme_turns(spark):
    table = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, None, "user", "c.")], CONV)
    got = {r["conv_id"]: r for r in cr.repair(table).collect()}
    assert got[1]["audit"] == "KK" and got[2]["gaps"] == 0


# --- licenses


def test_template_regions():
    a = license_scan.compile_template('use <<beginOptional>>and <<beginOptional>>also<<endOptional>> copy<<endOptional>> for <<var;name="x";words=1-2>> only')
    words = license_scan.words_of
    for text, end in (("Use for me only", 4), ("use AND copy; for you, me only", 7), ("use and also copy for a only x", 7), ("use also copy for a only", None), ("use for only", None), ("use for a b c only", None), ("use for only only", 4)):
        hit = a.match(words(text), 0)
        assert (hit and hit[0]) == end, text
    assert a.match(words("use and also copy for a only"), 0)[1] == 1.0 and a.match(words("use for a only"), 0)[1] == 0.5
    with pytest.raises(ValueError):
        license_scan.compile_template("<<beginOptional>>a<<endOptional>>").firsts()
    with pytest.raises(ValueError):
        license_scan.compile_template("a <<beginOptional>>b")
    endless = license_scan.compile_template('from <<var;name="x";words=0->> to')
    assert endless.match(words("from a to b to c"), 0)[0] == 5


def expanded(template: str) -> re.Pattern:
    """The template as a pattern over words joined by single spaces: the same by another way."""
    out = []
    for k, part in enumerate(re.split(r"<<(.*?)>>", template)):
        if k % 2 == 0:
            out += [re.escape(w) + " " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), part))]
        elif part.startswith("var"):
            least, most = re.search(r"words=(\d+)-(\d*)", part).groups()
            out.append(f"(?:[^ ]+ ){{{least},{most}}}")
        else:
            out.append("(?:" if part == "beginOptional" else ")?")
    return re.compile("".join(out))


def test_licenses_against_patterns(spark, tmp_path):
    full = {k: re.sub(r"<<var;[^<>]*>>", "Some Owner", re.sub(r"<<(begin|end)Optional>>", " ", v)) for k, v in license_scan.TEMPLATES.items()}
    bare = {k: re.sub(r"<<var;[^<>]*>>", "x y", re.sub(r"<<beginOptional>>(?:(?!<<(?:begin|end)O).)*<<endOptional>>", " ", re.sub(r"<<beginOptional>>(?:(?!<<(?:begin|end)O).)*<<endOptional>>", " ", v, flags=re.S), flags=re.S)) for k, v in license_scan.TEMPLATES.items()}
    texts = ["Head. " + v + " tail " + v for v in full.values()] + list(bare.values()) + [v.replace("License", "Lizenz").replace("permi", "perni") for v in full.values()]
    texts += ["Used under the MIT-License, under the mit licensee; UNDER THE MIT LICENSE!", "Apache  License\nVersion 2 apache license version 2.0", "cc by-nc CC BY NC", None, "", "straße Under the mit licenseß", "cc by nc " * 20_000, "İ under the mit license"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (None, texts[0], None)], "doc_id long, text string, n_words string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_template_licenses"](spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 2
    patterns = {k: expanded(v) for k, v in license_scan.TEMPLATES.items()}
    for r in got:
        text = texts[r["doc_id"] or 0] or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        base = [(k, i) for k, p in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for _, i in base]
        assert (r["n_words"], r["n_base"]) == (len(words), len(base))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({k for k, _ in base}))
        joined = " " + "".join(w + " " for w in words)
        if len(words) < 5000:
            own = {k for k, p in patterns.items() if any(p.match(joined, m.end()) for m in re.finditer(" ", joined))}
            assert r["labels"] == ",".join(sorted(own | {k for k, _ in base})), text[:60]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert queries.QUERIES["op13_template_licenses"](spark, "/root/testdata/sf0.001").where("labels <> ''").count()
