import random

import xxhash

from siftlog.llm import simhash
from tests.llm.cases import no_documents, odd_documents, some_documents


def plain_fingerprint(text, words=4, seed=42):
    parts = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    value = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, seed) >> bit & 1 for s in shingles) > len(shingles):
            value |= 1 << bit
    return value


def plain_components(rows, max_bits):
    """Smallest id reachable, over all pairs."""
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= max_bits:
                root[find(a)] = find(b)
    least = {}
    for k, (name, _) in enumerate(rows):
        if name is not None:
            least[find(k)] = min(name, least.get(find(k), name))
    return [(name, f"{fp:016x}", least.get(find(k))) for k, (name, fp) in enumerate(rows)]


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_all_documents_equal_brute_force(spark):
    docs = some_documents(spark)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == sorted(plain_components(rows, 4), key=str)


def test_odd_documents_equal_brute_force(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == sorted(plain_components(rows, 4), key=str)
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def near_prints(seed, centres, copies, flips):
    draw = random.Random(seed)
    prints = set()
    for _ in range(centres):
        centre = draw.getrandbits(64)
        for _ in range(copies):
            value = centre
            for bit in draw.sample(range(64), draw.randrange(flips + 1)):
                value ^= 1 << bit
            prints.add(value)
    return sorted(prints)


def linked_components(spark, prints, max_bits, block):
    frame = spark.createDataFrame([(simhash.signed(p), 0) for p in prints], "fp bigint, check bigint").repartition(3)
    links = simhash.link_fingerprints(frame, max_bits, block=block)
    pairs = [((r.a % 2**64), (r.b % 2**64)) for r in links.collect()]
    assert all(a != b and (a ^ b).bit_count() <= max_bits for a, b in pairs)
    roots = {r.node: r.root for r in simhash.components(links.selectExpr("a as u", "b as v")).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(roots.get(simhash.signed(p), simhash.signed(p)), []).append(p)
    return sorted(groups.values()), len(pairs)


def expected_groups(prints, max_bits):
    by_root = {}
    for name, fp, root in plain_components([(p, p) for p in prints], max_bits):
        by_root.setdefault(root, []).append(name)
    return sorted(by_root.values())


def test_links_of_scattered_and_dense_groups(spark):
    for max_bits, flips in ((4, 4), (1, 1), (7, 6)):
        prints = near_prints(max_bits, 40, 6, flips)
        assert linked_components(spark, prints, max_bits, 4096)[0] == expected_groups(prints, max_bits)


def test_a_hot_group_in_blocks_loses_no_link_and_makes_few(spark):
    prints = near_prints(5, 1, 700, 3) + near_prints(6, 20, 3, 5)
    groups, links = linked_components(spark, sorted(set(prints)), 4, 32)
    assert groups == expected_groups(sorted(set(prints)), 4)
    assert links < 60 * len(prints)


def test_ring_covers_all_bits_from_every_segment():
    for max_bits in (1, 4, 10):
        for masks in simhash.ring(max_bits):
            assert masks[-1] == 2**64 - 1 and len(masks) == max_bits + 1


def test_a_second_seed_drops_chance_links(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (3, "q w e r t z u i o p")], "doc_id bigint, text string")
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=5, max_bits=10, seeds=(42, 7), max_total=24).collect()}
    assert rows == {1: 1, 2: 1, 3: 3}
