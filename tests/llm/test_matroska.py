from sievemark.llm import matroska as M


def test_round_trip():
    for text in ["", None, "a", "é" * 5000, "x" * 64, "y" * 300_000]:
        body, n = M.padded(text)
        data = M.write(body)
        media = M.read(data)
        assert M.payload(data, media) == body and n == len((text or "").encode())
        assert [p[1] for p in media.packets] == [8 * i for i in range(len(body) // 64)]
        # Cues lead to clusters.
        assert [data[w : w + 4] for _, _, w in media.cues] == [M.CLUSTER.to_bytes(4, "big")] * len(media.clusters)


def test_lacing():
    packets = [b"a" * 3, b"b" * 700, b"c" * 255, b"d" * 5, b"e" * 20000, b""]
    for lacing in (M.XIPH, M.EBML_LACING):
        body = M.block(3, -5, packets, lacing, key=False)
        cluster = M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 50) + M.element(M.SIMPLE_BLOCK, body))
        data = M.element(M.SEGMENT, cluster)
        media = M.read(data)
        assert [data[a : a + n] for _, _, a, n, _ in media.packets] == packets
        assert {p[:2] for p in media.packets} == {(3, 45)} and not any(p[4] for p in media.packets)
    one = M.element(M.SEGMENT, M.element(M.CLUSTER, M.element(M.SIMPLE_BLOCK, M.block(1, 0, [b"only"], M.EBML_LACING))))
    assert [one[a : a + n] for _, _, a, n, _ in M.read(one).packets] == [b"only"]


def test_unknown_sizes_and_groups():
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, M.block(1, 2, [b"zz"], M.NO_LACING)) + M.uint(M.REFERENCE, 1))
    inner = M.uint(M.TIMESTAMP, 7) + group
    open_cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + inner
    data = M.SEGMENT.to_bytes(4, "big") + b"\xff" + open_cluster + open_cluster
    media = M.read(data)
    assert [(t, ms, data[a : a + n], k) for t, ms, a, n, k in media.packets] == [(1, 9, b"zz", False)] * 2


def test_files_are_what_they_were():
    """The bytes of a file depend on the text alone."""
    import hashlib

    text = "abc é " * 40_000
    body, _ = M.padded(text)
    packets = [body[i : i + 64] for i in range(0, len(body), 64)]
    data = M.write(body)
    media = M.read(data)
    first = media.clusters[0]
    laced = M.element(M.SIMPLE_BLOCK, bytes([0x81, 0, 0, 0x80 | M.FIXED << 1, 127]) + b"".join(packets[:128]))
    assert laced in data[first : first + 20_000]
    assert hashlib.sha256(M.payload(data, media)).hexdigest() == hashlib.sha256(body).hexdigest()


def test_long_text_takes_a_few_times_its_size():
    import tracemalloc

    body, _ = M.padded("x" * 20_000_000)
    tracemalloc.start()
    data = M.write(body)
    media = M.read(data)
    back = M.payload(data, media)
    assert M.feature(back, media).endswith(f"sum={120 * 20_000_000};energy={120 * 120 * 20_000_000};peak=120;crossings=0")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back == body and peak < 6 * len(body)


def test_packet_table(spark):
    bodies = {1: b"a" * 64, 2: bytes(range(64)) * 300, 3: b"z" * 64 * 5000}
    rows = [(i, bytearray(M.write(b))) for i, b in bodies.items()] + [(4, None), (None, bytearray(M.write(bodies[1]))), (1, bytearray(M.write(bodies[1])))]
    files = spark.createDataFrame(rows, "doc_id long, media binary").selectExpr("*", "1 as packet", "'x' as track")
    table = M.packet_table(files).collect()
    for i, body in bodies.items():
        own = sorted((r for r in table if r["doc_id"] == i), key=lambda r: r["packet"])
        data = bytes(dict(rows[:3])[i])
        n = len(body) // 64
        assert len(own) == (2 * n if i == 1 else n)
        if i != 1:
            assert b"".join(data[r["first_byte"] : r["first_byte"] + r["n_bytes"]] for r in own) == body
            assert [r["timestamp_ms"] for r in own] == [8 * k for k in range(n)] and [r["packet"] for r in own] == list(range(n))
    assert {r["doc_id"] for r in table} == {1, 2, 3, None} and all(r["track"] == 1 and r["is_key"] for r in table)
    assert M.packet_table(files.where("false")).isEmpty()
