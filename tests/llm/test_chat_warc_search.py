import base64
import hashlib
import io
import random

import numpy as np
import pytest
import zstandard as zstd
from hypothesis import given, settings
from hypothesis import strategies as st

from codelineage.llm import chat, kdtree, warc

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "[ROLE] ", " [/TEXT]", "[", "<", "/", "ok", " ", "é", "\n", "[AN", "S]"]


def test_turns_read_back_whatever_they_say(spark):
    rng = random.Random(16)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(PIECES) for _ in range(rng.randrange(8)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool [/ROLE]", None]), text))
    rows += [(None, 0, "user", "x"), (None, None, "user", ""), (41, 3, "user", "b"), (41, 3, "user", "a"), (41, 3, "user", "a"), (41, 3, "assistant", "z")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    turns = chat.format_turns(spark.createDataFrame([(*r, 1) for r in shuffled], "conv_id long, turn long, role string, text string, seq int"))
    formatted = {}
    for r in turns.orderBy("conv_id", "seq").collect():
        formatted.setdefault(r["conv_id"], []).append([tuple(s) for s in r["segments"]])
    got = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, own in by_conv.items():
        own.sort()
        said = "".join(t for _, r, t in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert tuple(got[conv])[1:5] == want
        assert got[conv]["formatted_chars"] == sum(len(t) for segs in formatted[conv] for t, _ in segs)
        for (_, role, text), segs in zip(own, formatted[conv]):
            assert chat.parse_turn("".join(t for t, _ in segs)) == (role, text)
            assert not any(c in t for t, loss in segs if loss for c in chat.DEFAULT.controls)
    assert chat.read_back(turns.limit(0)).count() == 0


@pytest.mark.parametrize(
    "roles,valid",
    [("user assistant", True), ("system user assistant user assistant", True), ("assistant", False), ("user user assistant", False), ("user", False), ("user assistant system user assistant", False), ("tool", False)],
)
def test_machine_validates_turn_order(spark, roles, valid):
    rows = [(1, i, r, "t") for i, r in enumerate(roles.split())]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chat.read_back(turns).first()["valid"] == valid


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_archive_frames_round_trip(payloads):
    class Store:
        def open_output_stream(self, path):
            self.out = io.BytesIO()
            self.out.close, self.closed = lambda: None, True
            return self.out

    store = Store()
    archive = warc.Archive(store, "a")
    for i, body in enumerate(payloads):
        archive.add(warc.record(i, f"http://x/{i}?a=é b\r\n", body, i if i % 3 else 0))
    archive.close()
    data = store.out.getvalue()
    got = [warc.parse(x) for x in warc.frames(io.BytesIO(data))]
    assert [g[0] for g in got] == list(range(len(payloads)))
    for i, (page, url, n, digest, kind, refers, body) in enumerate(got):
        assert url == f"http://x/{i}?a=é b\r\n" and n == len(payloads[i])
        assert digest == base64.b32encode(hashlib.sha1(payloads[i]).digest()).decode()
        response = i == (i if i % 3 else 0)
        assert (kind, refers) == (("response", None) if response else ("revisit", 0))
        assert body == (payloads[i] if response else b"")
    # without our own reader: the skippable frame, then independent frames with its dictionary
    size = int.from_bytes(data[4:8], "little")
    one = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(data[8 + size :])
    assert one.startswith(b"WARC/1.1\r\n")


def test_pages_round_trip(spark):
    rng = random.Random(17)
    big = "".join(rng.choice("abc <>é") for _ in range(300000))
    rows = [(5, "u", "same"), (3, "u", "same"), (9, None, "same"), (3, "v", "same"), (7, "u", None), (8, "u", ""), (1, "u", big), (None, "u", "same"), (None, "u", "only"), (2, "u", "x")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, digest string")
    for least in (0, 3):
        folder = warc.new_folder(spark)
        manifest = warc.write_archives(df, folder, min_bytes=least)
        got = [(*tuple(r)[:6], bytes(r["payload"])) for r in warc.read_archives(manifest, folder).collect()]
        want = []
        for page, url, html in rows:
            body = (html or "").encode()
            same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
            first = min(same) if same and len(body) >= least else page
            kind = "response" if page == first else "revisit"
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            want.append((page, url or "", len(body), digest, kind, None if kind == "response" else first, body if kind == "response" else b""))
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    folder = warc.new_folder(spark)
    assert warc.read_archives(warc.write_archives(df.limit(0), folder), folder).count() == 0


def brute(rows, k, step):
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            p = tuple(int(np.floor(64 * float(x))) for x in v)
            best[i] = min(best.get(i, p), p)
    out = []
    for q, v in best.items():
        if q % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in best.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block", [(10**6, 10**6), (50, 3), (17, 1)])
def test_search_matches_brute_force(spark, shard_rows, block):
    rng = np.random.default_rng(18)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(220)]
    rows += [(300 + i, [0.5] * 6) for i in range(60)]  # many ties
    rows += [(500, None), (501, []), (502, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (505, [float("nan")] * 6), (510, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(520, [1.0, 2.0]), (525, [3.0, -1.0]), (0, [9.0] * 6), (530, [-2.0] * 6), (530, [-2.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, point int")
    points = kdtree.scaled(df)
    got = kdtree.top_k(points, points["vec_id"] % 5 == 0, 7, shard_rows=shard_rows, block_queries=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, 7, 5)


def test_search_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert kdtree.top_k(kdtree.scaled(none), kdtree.F.col("vec_id") % 5 == 0, 3).count() == 0
    large = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e7, -1e7]), (2, [-1e8, 3.0])], "vec_id long, embedding array<double>")
    got = kdtree.top_k(kdtree.scaled(large), kdtree.F.col("vec_id") == 0, 9).collect()
    assert sorted(map(tuple, got)) == brute([(0, [1e7, 1.0]), (1, [1e7, -1e7]), (2, [-1e8, 3.0])], 9, 20)


def test_tree_leaves_hold_every_point_once():
    points = np.random.default_rng(19).integers(-50, 50, (1000, 4))
    leaves = kdtree.build(points, 30)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000)) and max(map(len, leaves)) <= 30
    assert all(len(x) for x in kdtree.build(np.zeros((500, 3), np.int64), 20))


def test_descent_opens_the_best_boxes_and_no_box_hides_a_hit():
    rng = np.random.default_rng(20)
    centres = rng.integers(-2000, 2000, (16, 5))
    points = (centres[rng.integers(0, 16, 4000)] + rng.integers(-20, 20, (4000, 5))).astype(np.int64)
    tree = kdtree.grow(points, 50)
    ids, inside = tree.rows.astype(np.int64) * 3, points[tree.rows]
    queries = points[:40]
    bounds = kdtree.box_bounds(queries, tree.low, tree.high)
    for node in range(len(tree.child)):
        part = inside[tree.begin[node] : tree.end[node]]
        assert ((part >= tree.low[node]) & (part <= tree.high[node])).all()
        assert ((queries @ part.T).max(axis=1) <= bounds[:, node]).all()
    for i, query in enumerate(queries):
        names, scores, opened = kdtree.descend(tree, ids, inside, 3 * i, query, bounds[i], kdtree.LOWEST, 6)
        every = points @ query
        want = sorted((-int(s), 3 * j) for j, s in enumerate(every) if j != i)[:6]
        assert [(-s, n) for s, n in sorted(zip(scores.tolist(), names.tolist()), key=lambda x: (-x[0], x[1]))] == want
        assert opened < len(tree.child) / 3
        kth = int(scores.min())
        again, _, fewer = kdtree.descend(tree, ids, inside, 3 * i, query, bounds[i], kth, 6)
        assert sorted(again.tolist()) == sorted(names.tolist()) and fewer <= opened
        assert kdtree.descend(tree, ids, inside, 3 * i, query, bounds[i], int(bounds[i].max()) + 1, 6)[2] == 0


def test_queries_reach_only_shards_whose_root_box_can_beat_their_bound(spark):
    rows = [(i, [i % 7, -3]) for i in range(40)] + [(100 + i, [900 + i, 5]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, point array<bigint>").selectExpr("2 AS dims", "if(vec_id < 100, 0, 70) AS shard", "vec_id", "point")
    trees = kdtree.plant(df)
    assert [(t["dims"], t["shard"], t["width"]) for t in trees.orderBy("shard").collect()] == [(2, 0, 2), (2, 70, 2)]
    asked = [(2, 0, 1, 100, [1, 0]), (2, 0, 2, 939, [1, 0]), (2, 0, 3, 940, [1, 0]), (2, 70, 4, -5, [1, 0]), (2, 70, 5, 7, [1, 0])]
    queries = spark.createDataFrame(asked, "dims int, home int, query_id long, bound long, query array<bigint>")
    sent = kdtree.routes(kdtree.packed(queries, "dims", "home"), trees, 71).selectExpr("shard", "explode(queries.query_id) AS q")
    assert sorted(map(tuple, sent.collect())) == [(0, 4), (70, 1), (70, 2)]
    hits = kdtree.meet(trees, queries.withColumn("shard", kdtree.F.lit(70)).transform(lambda d: kdtree.packed(d, "dims", "shard")), 2, 3)
    assert sorted(map(tuple, hits.where("query_id = 1").collect())) == [(1, 138, 938), (1, 139, 939)]


def test_archives_are_read_by_tasks_in_proportion_to_their_bytes(spark):
    manifest = spark.range(2000).selectExpr("concat('a', id) AS path", "10L AS records", f"{warc.ARCHIVE_BYTES}L AS raw_bytes")
    assert warc.read_archives(manifest, "file:///nowhere").rdd.getNumPartitions() == 2000
    small = spark.range(40).selectExpr("concat('a', id) AS path", "1L AS records", f"{warc.READ_BYTES // 8}L AS raw_bytes")
    assert warc.read_archives(small, "file:///nowhere").rdd.getNumPartitions() == 5
