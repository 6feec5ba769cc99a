"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import hashlib
import random
import struct
import zipfile
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lipika.llm import common, langid, lines, lzprint, media, mixing, packing, queries, sharding, simhash, substrings, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, words string, shard string, key string, host string, tokens string"


def words(rnd: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(vocabulary * rnd.random() ** 2)}" for _ in range(n))


def sample_texts() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(7)
    base = [words(rnd, rnd.randrange(1, 120)) for _ in range(40)]
    near = [t.replace("w1 ", "w2 ", 1) for t in base[:8]]
    shared = words(rnd, 40)
    passages = [words(rnd, 30) + " " + shared + " " + words(rnd, 20) for _ in range(6)]
    odd = [None, "", " \t\n", "A.", "ß Ünï x", "a\x1cb\x85c", "?! ...", words(rnd, 6000), "x" * 70_000, "same same " * 400]
    texts = base + base[:5] + near + passages + odd
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, base[2]), (None, None)]  # a repeated row, null keys


@pytest.fixture(scope="module")
def rows():
    return sample_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs = ["en", "de", None]
    data = [(i, t, langs[(i or 0) % 3], f"src{(i or 0) % 4}" if i != 9 else None, len(t or ""), "a", "b", "c", "d", "e", "f") for i, t in rows]
    return spark.createDataFrame(data, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def byte_words(t: str | None) -> list[bytes]:
    return (t or "").encode().split()


def gathered(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- 1 media

def test_media_round_trip(spark, docs, rows, empty, tmp_path):
    path = common.new_dir(spark, "media")
    assert media.write_archives(docs, path) == len(rows)
    got = gathered(media.media_features(media.read_archives(spark, path, rangeBytes="2000")), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert got == want
    none = common.new_dir(spark, "media")
    assert media.write_archives(empty, none) == 0
    assert media.media_features(media.read_archives(spark, none)).count() == 0


def test_media_archives_are_zip_files_and_damage_is_told(spark, docs, rows):
    import pathlib

    path = common.new_dir(spark, "media")
    media.write_archives(docs.coalesce(1), path)
    [file] = pathlib.Path(path.removeprefix("file://")).glob("*.zip")
    with zipfile.ZipFile(file) as z:
        assert z.testzip() is None and len(z.namelist()) == len(rows)
        offset = z.infolist()[5].header_offset
    raw = bytearray(file.read_bytes())
    raw[offset + 60] ^= 1
    file.write_bytes(raw)
    found = media.read_archives(spark, path, mode="permissive", retries="1").collect()
    assert sum(r["error"] is not None for r in found) == 1 and len(found) == len(rows)
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, path, retries="0").collect()


def test_png_row_filters():
    rnd = np.random.default_rng(1)
    image = rnd.integers(0, 256, (6, 8), dtype=np.uint8)
    out, above = b"", np.zeros(8, dtype=np.uint8)
    for kind, row in zip((0, 1, 2, 3, 4, 4), image):
        left, corner = np.concatenate(([0], row[:-1])).astype(int), np.concatenate(([0], above[:-1])).astype(int)
        up = above.astype(int)
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * up, left, up, (left + up) // 2, paeth][kind]
        out += bytes([kind]) + ((row.astype(int) - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = media.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")
    assert media.decode_png(png) == (image.tobytes(), None)


# ---- 2 packing

def test_packing(docs, rows, empty):
    file = queries.vocabulary()
    got = packing.pack(docs, file).collect()
    tokenizer = packing.word_ids(file).tokenizer
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    want = Counter()
    for i, t in rows:
        want[i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    assert Counter({k: sum(r["start"] == 0 for r in v) for k, v in pieces.items()}) == want
    for i, t in dict(rows).items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        if i is None or i == 3:
            continue
        at = 0
        for r in sorted(pieces[i, len(ids)], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
    held = padded = 0
    for found in sequences.values():
        at = 0
        for offset, n, _ in sorted(found):
            assert offset == at
            at += n
        assert at <= 2048 and {x[2] for x in found} == {at if at & (at - 1) == 0 else 2048}
        held, padded = held + at, padded + found[0][2] - at
    assert padded <= 0.01 * held
    assert packing.pack(empty, file).count() == 0


def test_packed_pieces_hold_their_ids(docs, rows):
    file = queries.vocabulary()
    tokenizer = packing.word_ids(file).tokenizer
    whole = defaultdict(dict)
    for r in packing.pack_pieces(docs, file).collect():
        assert len(r["ids"]) == 4 * r["length"]
        if r["doc_id"] not in (None, 3):
            whole[r["doc_id"]][r["start"]] = bytes(r["ids"])
    for i, t in dict(rows).items():
        if i not in (None, 3):
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            assert np.frombuffer(b"".join(p for _, p in sorted(whole[i].items())), "<u4").tolist() == ids


def test_cut_covers_every_length():
    for n in range(1, 5000):
        found = packing.cut(n, 2048, 4, 3)
        assert sum(x for _, x in found) == n
        assert all(k * size <= 2048 for k, size in found)


def test_added_tokens_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    ids, plain = packing.WordIds(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())
    for t in ("<|endoftext|>", "a b<|endoftext|>c <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext| >", "é<|endoftext|>'s\x1c<|startoftext|>"):
        assert np.frombuffer(ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_words_have_the_tokenizers_ids():
    ids, rnd = packing.WordIds(queries.vocabulary()), random.Random(1)
    for _ in range(2000):
        t = "".join(rnd.choice("abCéÀÖ×'s.,$12 \t\n\x1c\x85Σßıİ́<|>中​ ") for _ in range(rnd.randrange(30)))
        assert np.frombuffer(ids(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


# ---- 3 line dedup

def page_table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, lines string")


def test_page_lines(spark):
    boiler = "<nav>Menu</nav><script>x<1</script><!-- <p>no</p> -->"
    rows = [(i, f"http://a.org/{i}", f"{boiler}<p>text {i}</p> <br>&amp;", "x", "y") for i in range(6)]
    rows += [(6, "https://user@A.org:80/q", boiler + "<p>text 0", "x", "y"), (7, None, None, None, None), (8, "nonsense", "", "x", "y"), (9, "http://b.org", "alone", "x", "y"), rows[1]]
    got = gathered(lines.dedup_page_lines(page_table(spark, rows)), "page_id", "host", "n_lines", "n_dropped", "kept_md5")
    want = Counter()
    for i, url, html, *_ in rows:
        on_a = i is not None and i < 7
        kept = ([f"text {i % 6}"] + ([] if i == 6 else [])) if on_a else ["alone"] if i == 9 else []
        n = (3 if i < 6 else 2) if on_a else len(kept)
        want[i, "a.org" if on_a else "b.org" if i == 9 else "", n, n - len(kept), hashlib.md5("\n".join(kept).encode()).hexdigest()] += 1
    assert got == want
    assert lines.dedup_page_lines(page_table(spark, rows).limit(0)).count() == 0


def test_copies_of_a_page_count_each_unless_distinct(spark):
    copies = [(i, "http://a.org", "<p>copy of it</p>", "x", "y") for i in range(5)] + [(5 + i, "http://a.org", f"<p>own {i}</p>", "x", "y") for i in range(5)]
    dropped = lambda **k: {r["page_id"] for r in lines.dedup_page_lines(page_table(spark, copies), **k).collect() if r["n_dropped"]}
    assert dropped() == set(range(5)) and dropped(distinct=True) == set() and dropped(ratio=0.5) == set()


def test_no_column_name_is_taken(spark):
    names = ["boiler", "of_host", "kept", "host", "lines", "page", "fp", "least", "node", "digest", "k", "domain", "tokens", "rank"]
    df = spark.createDataFrame([(i, f"common\nown {i} a b c d e f", "en", f"src{i % 2}", 9, *["z"] * len(names)) for i in range(12)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    for out in (lines.drop_boilerplate_lines(df), simhash.keep_one_of_each(df), langid.keep_identified(df), mixing.keep_mixed(df, queries.MIX, queries.source_domain(), 1.0, 1)):
        assert out.columns == df.columns and out.select("boiler", "kept", "domain").distinct().collect() == [("z", "z", "z")]


def test_document_lines(spark, docs, rows):
    data = [(i, f"common\n\nown {i}\n  common ", "s") for i in range(30)] + [(30, None, "s"), (31, "common", None), (32, "common\nlast", "t")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.drop_boilerplate_lines(df).collect()}
    assert got == {i: (f"\nown {i}", len(f"\nown {i}")) for i in range(30)} | {30: (None, None), 31: ("common", 6), 32: ("common\nlast", 11)}
    out = lines.drop_boilerplate_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_license_line_of_a_small_source_goes(spark):
    df = spark.createDataFrame([(i, f"license\nown {i}", "s") for i in range(9)] + [(9, "license\nx", "t"), (10, "license\ny", "t")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate_lines(df).collect()}
    assert got == {i: f"own {i}" for i in range(9)} | {9: "license\nx", 10: "license\ny"}


# ---- 4 fingerprints

def plain_phrases(t):
    """LZ78 by its definition."""
    seen, at = set(), 0
    while at < len(t):
        end = at + 1
        while end < len(t) and t[at:end] in seen:
            end += 1
        seen.add(t[at:end])
        at = end
    return seen


def plain_hash(phrase):
    """A phrase's 32 bits, by plain whole numbers."""
    if len(phrase) > lzprint.BLOCK:
        return int.from_bytes(hashlib.blake2b(phrase.encode(), digest_size=8).digest(), "little") >> 32
    h = sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(phrase)) % (1 << 64)
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return (h ^ (h >> 29)) >> 32


def plain_signature(t):
    return sorted({plain_hash(p) for p in plain_phrases(t)})[:64]


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    union = sorted(set(a) | set(b))[:64]
    return len(set(a) & set(b) & set(union)) / len(union)


def plain_fingerprints(rows):
    order = sorted((i, t or "") for i, t in rows if i is not None)
    text = lambda sig: "".join(f"{v:08x}" for v in sig)
    known = {}
    sign = lambda t: known.setdefault(t, None) or known.update({t: plain_signature(t)}) or known[t]
    want = Counter()
    for n, (i, t) in enumerate(order):
        follow = order[(n + 1) % len(order)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + follow[:m]
        a, b, c = sign(t), sign(edited), sign(follow)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), plain_likeness(a, b), plain_likeness(a, c)] += 1
    for i, t in rows:
        if i is None:
            want[None, len(t or ""), None, text(sign(t or "")), None, None, None] += 1
    return want


FINGERPRINT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_fingerprints(docs, rows, empty):
    assert gathered(lzprint.fingerprints(docs), *FINGERPRINT) == plain_fingerprints(rows)
    assert lzprint.fingerprints(empty).count() == 0


@pytest.mark.parametrize(
    "keys",
    [
        [-(1 << 63), -5 * 10**18, 1, 2, 5 * 10**18, (1 << 63) - 1],
        [*range(200), 10**15],
        [7] * 300 + [8, 9, (1 << 63) - 1],
        [5],
        [3, 3],
    ],
)
def test_fingerprints_of_far_and_repeated_keys(spark, keys):
    rnd = random.Random(len(keys))
    rows = [(k, rnd.choice(["same text", "same words", words(rnd, rnd.randrange(12)), None, "ÿ" + words(rnd, 3)])) for k in keys]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert gathered(lzprint.fingerprints(df), *FINGERPRINT) == plain_fingerprints(rows)


def test_ranges_have_equally_many_rows(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3999, F.col("id")).otherwise(10**15).alias("doc_id"), F.col("id").cast("string").alias("text"))
    sizes = lzprint.with_next(df).where("NOT guard").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in sizes.collect()) < 1.2 * 4000 / 4
    one = spark.range(100_000).select(F.lit(7).alias("doc_id"), F.concat(F.hex(F.xxhash64("id")), F.lit("x")).alias("text"))
    sizes = lzprint.with_next(one).where("NOT guard").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in sizes.collect()) < 1.2 * 100_000 / 4


def test_single_document_follows_itself(spark):
    r = lzprint.fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0


def test_parse_is_lz78():
    rnd = random.Random(3)
    for _ in range(400):
        t = "".join(rnd.choice("ab") for _ in range(rnd.randrange(80)))
        seen, at, want = set(), 0, []
        while at < len(t):
            end = at + 1
            while end < len(t) and t[at:end] in seen:
                end += 1
            seen.add(t[at:end])
            want.append(end)
            at = end
        ends: list[int] = []
        lzprint.parse(t, 0, set(), ends)
        assert ends == want
        other = "".join(rnd.choice("ab") for _ in range(rnd.randrange(80)))
        edited, sig = lzprint.Document(t).edited(other)
        assert lzprint.as_text(sig) == lzprint.fingerprint(edited)


def test_estimates_are_close():
    rnd = random.Random(5)
    t = words(rnd, 3000)
    for cut in (0.2, 0.5, 0.8):
        u = t[: int(len(t) * cut)] + words(rnd, int(3000 * (1 - cut)), 5000)
        parts = []
        for x in (t, u):
            ends: list[int] = []
            seen: set[str] = set()
            lzprint.parse(x, 0, seen, ends)
            parts.append(seen)
        exact = len(parts[0] & parts[1]) / len(parts[0] | parts[1])
        estimate = lzprint.likeness(lzprint.from_text(lzprint.fingerprint(t)), lzprint.from_text(lzprint.fingerprint(u)))
        assert abs(estimate - exact) < 0.2


# ---- 5 mixing

def fill(budget: int, weights: list[float], limits: list[int]) -> list[int]:
    """``budget`` shared by weight, nobody above its limit, shortages to the others by weight.

    Weights count in millionths and shares are rounded down, so that every engine gets the same.
    """
    parts = [round(w * mixing.MILLION) for w in weights]
    order = sorted((i for i, w in enumerate(parts) if w > 0), key=lambda i: Fraction(limits[i], parts[i]))
    out, left, weight = [0] * len(weights), budget, sum(parts[i] for i in order)
    for n, i in enumerate(order):
        if limits[i] * weight <= left * parts[i]:
            out[i] = limits[i]
            left, weight = left - limits[i], weight - parts[i]
        else:
            for j in order[n:]:
                out[j] = min(limits[j], left * parts[j] // weight)
            break
    return out


def brute_budgets(root: mixing.Node, supply: dict[tuple[str, ...], int], total: int) -> dict[tuple[str, ...], int]:
    """Budget of each leaf path, given what it can supply."""
    if not supply:
        return {}
    if () in supply:
        return {(): min(total, supply[()])}
    parts: dict[str, dict[tuple[str, ...], int]] = {}
    for path, n in supply.items():
        parts.setdefault(path[0], {})[path[1:]] = n
    names = sorted(parts)
    nodes = [root.child(name) for name in names]

    def usable(node: mixing.Node, below: dict[tuple[str, ...], int]) -> int:
        return sum(n for path, n in below.items() if all_positive(node, path))

    shares = fill(total, [n.weight for n in nodes], [usable(n, parts[x]) for n, x in zip(nodes, names)])
    return {(name, *path): b for name, node, share in zip(names, nodes, shares) for path, b in brute_budgets(node, parts[name], share).items()}


def all_positive(node: mixing.Node, path: tuple[str, ...]) -> bool:
    for name in path:
        node = node.child(name)
        if node.weight <= 0:
            return False
    return True


def spark_budgets(spark, tree, supply, total, epochs=1):
    leaves = spark.createDataFrame([(*p, n) for p, n in supply.items()], "domain string, lang string, source string, tokens long")
    return {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaves, tree, total, epochs).collect()}


def test_budgets_redistribute_among_siblings_before_ancestors(spark):
    tree = mixing.Node(children={"a": mixing.Node(1, {"x": mixing.Node(1), "y": mixing.Node(1)}), "b": mixing.Node(1)})
    supply = {("a", "x", "1"): 10, ("a", "y", "1"): 1000, ("b", "z", "1"): 1000}
    assert spark_budgets(spark, tree, supply, 200) == {("a", "x", "1"): 10, ("a", "y", "1"): 90, ("b", "z", "1"): 100}
    short = {("a", "x", "1"): 10, ("a", "y", "1"): 20, ("b", "z", "1"): 1000}
    assert spark_budgets(spark, tree, short, 200) == {("a", "x", "1"): 10, ("a", "y", "1"): 20, ("b", "z", "1"): 170}


def test_budgets_are_those_of_filling_node_by_node(spark):
    rnd = random.Random(3)
    for total, epochs in ((137, 1), (1500, 2)):
        weight = lambda: rnd.choice([0, 0.25, 1, 1, 2.5])
        tree = mixing.Node(default=rnd.choice([0.5, 1]))
        for d in "ab":
            tree.children[d] = mixing.Node(weight(), {x: mixing.Node(weight(), {"1": mixing.Node(weight())}, rnd.choice([0, 1])) for x in "xy"}, weight())
        supply = {(d, x, str(n)): rnd.choice([0, 3, 50, 50, 400]) for d in "abc" for x in "xyz" for n in range(4)}
        want = brute_budgets(tree, {p: n * epochs for p, n in supply.items()}, total)
        assert spark_budgets(spark, tree, supply, total, epochs) == want


def brute_mix(rows, share, epochs):
    leaf = defaultdict(list)
    for i, t, l, s in rows:
        n = (s or "")[3:]
        leaf["other" if not n.isdigit() else "web" if int(n) < 12 else "library", l or "", s or ""].append((i, len(byte_words(t))))
    tokens = {p: sum(x[1] for x in v) for p, v in leaf.items()}
    found = brute_budgets(queries.MIX, {p: n * epochs for p, n in tokens.items()}, int(share * sum(tokens.values())))
    out = Counter()
    for p, v in leaf.items():
        whole, rest = divmod(found[p], tokens[p]) if tokens[p] else (0, 0)
        rank = lambda i: int(hashlib.md5(f"{queries.MIX_SEED}|{whole}|{'' if i is None else i}".encode()).hexdigest()[:15], 16)
        for i, n in v:
            before = sum(m for j, m in v if rank(j) <= rank(i))
            copies = whole + (rest > 0 and before <= rest)
            if copies:
                out[i, p, n, copies] += 1
    return out


def test_mixing_beyond_a_broadcast(docs, monkeypatch):
    keep = lambda: Counter(r["doc_id"] for r in mixing.keep_mixed(docs, queries.MIX, queries.source_domain(), 0.5, 1).collect())
    want = keep()
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert keep() == want


@pytest.mark.parametrize("share,epochs", [(0.75, 4), (0.2, 1), (1.0, 1), (5.0, 2)])
def test_mixing(docs, share, epochs):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    got = mixing.mix(docs, queries.MIX, queries.source_domain(), share, epochs, queries.MIX_SEED).collect()
    assert Counter((r["doc_id"], (r["domain"], r["lang"], r["source"]), r["tokens"], r["copies"]) for r in got) == brute_mix(rows, share, epochs)
    if epochs == 1:
        kept = mixing.keep_mixed(docs, queries.MIX, queries.source_domain(), share, queries.MIX_SEED)
        assert kept.columns == docs.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got)


def test_mixing_nothing(empty):
    assert mixing.mix(empty, queries.MIX, queries.source_domain(), 0.5, 2, 1).count() == 0


# ---- 6 toxicity

def brute_segments(scores):
    """Maximal scoring segments by their definition: recursively the best segment, then left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return brute_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_segments():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        scores = rnd.integers(-4, 4, rnd.integers(0, 25)) + rnd.random() * 0.001
        got = toxicity.segments(np.asarray(scores, dtype=float))
        want = brute_segments(np.asarray(scores, dtype=float).tolist())
        assert [(round(s, 6)) for *_, s in got] == [round(s, 6) for *_, s in want]


def test_toxicity(spark, docs, rows, empty):
    rnd = random.Random(11)
    bad = ["vile", "nasty", "viler"]
    texts = []
    for i in range(400):
        t = words(rnd, 60).split()
        toxic = i % 3 == 0
        for _ in range(rnd.randrange(1, 4) if toxic else 0):
            t.insert(rnd.randrange(len(t)), rnd.choice(bad))
        texts.append((i, " ".join(t), int(toxic)))
    table = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None), (99_999, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(table.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r for r in toxicity.score(table.select("doc_id", "text"), model).collect()}
    for i, _, toxic in texts:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    held = [(got[i]["predicted"], toxic) for i, _, toxic in texts if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty, model).count() == 0
    untaught = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, untaught).collect()} == {0}


def toxic_table(spark, n, seed):
    """Labelled texts: two toxic words in every third, after which the text goes on as the others do."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        t = words(rnd, rnd.randrange(5, 60)).split()
        for _ in range(2 if i % 3 == 0 else 0):
            t.insert(rnd.randrange(len(t) + 1), rnd.choice(["idiotic", "Moron,", "trash", "loser!"]))
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def plain_scores(texts):
    """Every level's score by the formula, a level at a time, from (text, label)."""
    texts = set(texts)
    n1 = sum(y for _, y in texts)
    base = np.log(n1 / (len(texts) - n1))
    counts = defaultdict(lambda: [0, 0])
    for t, y in texts:
        stems = set()
        for w in {"".join(c for c in w if c.isalpha()) for w in t.lower().split()} - {""}:
            stems |= {(0, w)} | {(n, w[:n]) for n in (3, 4, 5) if len(w) >= n}
        for s in stems:
            counts[s][y] += 1
    scores = {}
    for level in (3, 4, 5, 0):
        for (n, stem), (y0, y1) in counts.items():
            if n == level and (n or y0 + y1 > 1):
                prior = next((scores[m, stem[:m]] for m in (5, 4, 3) if (not n or m < n) and (m, stem[:m]) in scores and len(stem) >= m), 0.0)
                toxic = 5.0 / (1 + np.exp(-(prior + base)))
                found = np.log((y1 + toxic) / (y0 + 5.0 - toxic)) - base
                error = 1.5 * np.sqrt(1 / (y1 + toxic) + 1 / (y0 + 5.0 - toxic))
                scores[n, stem] = np.sign(found) * max(abs(found) - error, 0)
    return scores


def test_toxicity_fit_and_score_by_hand(spark):
    rows, table = toxic_table(spark, 500, 3)
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    kept = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    want = plain_scores(kept)

    def score_of(w):
        return next((want[n, w[: n or None]] for n in (0, 5, 4, 3) if (n, w[: n or None]) in want and len(w) >= n), 0.0)

    known = {"".join(c for c in w if c.isalpha()) for t, _ in kept for w in t.lower().split()} - {""}
    assert len(known) > 1 and max(abs(score_of(w) - model.lookup(w)) for w in known) < 1e-9
    assert {x for x in model.known} == {xxhash.xxh64_intdigest(w.encode(), 42) for w in known}
    assert model.log_odds == pytest.approx(np.log(sum(y for _, y in set(kept)) / sum(1 - y for _, y in set(kept))))
    # the tail: of clean texts scored by the other folds, one in a hundred is above 4.6 nats (and one in ten above 2.25, or nearly)
    assert model.scale >= 1 and model.lam > 0 and model.mean >= 2
    got = {r["doc_id"]: r for r in toxicity.score_passages(table, model).collect()}
    caught = left = 0
    for i, t, y in rows:
        tokens = t.split()
        scores, seen = [], Counter()
        for w in tokens:
            s = score_of("".join(c for c in w if c.isalpha()).lower()) - 0.7
            if s > 0:
                seen[w] += 1
                s /= seen[w]
            scores.append(s)
        significant = [(model.lam * s - np.log(len(tokens)) - model.place) / model.scale for *_, s in brute_segments(scores)]
        best = max(significant, default=-10.0)
        x = sorted((s for s in significant if s > np.log(100)), reverse=True)
        if len(x) > 1:
            best = max(
                sum(x[:r]) - (r - 1) * np.log(max(sum(x[:r]), 1)) + sum(np.log(range(1, r + 1))) + sum(np.log(range(1, r))) - (r - 1) * np.log(2) for r in range(1, len(x) + 1)
            )
        z = model.log_odds - np.log(model.mean) + (1 - 1 / model.mean) * max(best, -10.0)
        if all("".join(c for c in w if c.isalpha()).lower() in known or not w.strip("0123456789") for w in tokens):
            assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
        caught, left = caught + (y and got[i]["predicted"]), left + (not y and not got[i]["predicted"])
    assert caught >= 0.95 * sum(y for *_, y in rows) and left >= 0.99 * sum(1 - y for *_, y in rows)


def test_altered_spellings_are_read(spark):
    rows, table = toxic_table(spark, 900, 5)
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    clean = "w1 w2 w5 w9 w3 w1 w30 w2"
    assert model.score(clean) < 0.5
    for word in ("TRASH", "tr4sh", "t.r.a.s.h", "t r a s h", "tr*sh", "trashes", "traaash", "m0r0n", "morоn", "ｌｏｓｅｒ", "lo\u200bser", "yourtrash", "tra-sh"):
        assert model.score(f"{clean} {word} {clean}") >= 0.5, word
    assert model.score("") < 0.5 and model.score("w1 5 # 7 8 9 a b c d") < 0.5


def test_toxicity_of_odd_labels(spark):
    rows, table = toxic_table(spark, 300, 9)
    docs = table.select("doc_id", "text")
    labels = table.select("doc_id", "toxic")
    both = toxicity.fit(docs.union(docs), labels.union(labels))  # repeated rows teach once
    once = toxicity.fit(docs, labels)
    assert both.scores == pytest.approx(once.scores) and both.log_odds == pytest.approx(once.log_odds)
    only = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {r["predicted"] for r in toxicity.score(docs, only).collect()} == {1}


def test_significant_passages_are_given(spark, docs):
    texts = [(i, "vile nasty viler " * 3 + "w1 w2 w3" if i % 3 == 0 else f"w{i % 7} w2 w3 w{i % 5} w1") for i in range(300)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.fit(table, table.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    significant = 0
    for r in toxicity.score_passages(table, model).collect():
        text = texts[r["doc_id"]][1]
        assert [tuple(p) for p in r["passages"]] == [p for p in model.passages(text) if p[2] > 0] and r["score"] == model.score(text)
        significant += len(r["passages"])
    assert significant >= 100


# ---- 7 language ID

def test_language_id(spark, docs, rows, empty):
    rnd = random.Random(13)
    sounds = {"xx": ["ka", "mi", "tu", "ro"], "yy": ["ß", "öl", "gen", "sch"]}
    data = [(i, " ".join("".join(rnd.choice(sounds[l]) for _ in range(rnd.randrange(1, 5))) for _ in range(30)), l) for i in range(300) for l in [("xx", "yy")[i % 2]]]
    extra = [(1000, None, "xx"), (1001, "", None), (1002, "12 !!", "yy"), (1003, "中文", None), (None, "kami", "xx"), data[4]]
    table = spark.createDataFrame(data + extra, "doc_id long, text string, lang string")
    model = langid.fit(table)
    got = defaultdict(list)
    for r in langid.predict(table, model).collect():
        got[r["doc_id"]].append(r)
    assert len(got[4]) == 2
    for i, _, l in data:
        r = got[i][0]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["lang_pred"] == l and 0 <= r["score"] <= 1
    assert [got[i][0]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003][0]["lang_pred"] == "xx" and got[1003][0]["score"] == 0.5  # nothing known: a tie
    assert got[None][0]["held_out"] is False
    kept = langid.keep_identified(table)
    assert kept.columns == table.columns and kept.count() == len(data) + 3
    assert len(langid.predict(docs, model).collect()) == len(rows)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_every_language_is_learned(spark):
    df = spark.createDataFrame([(i, f"q{chr(97 + i % 20)}{chr(97 + i % 300 // 20)} common " * 2, f"l{i % 300}") for i in range(2400)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.languages) == 300
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 300}" for r in langid.predict(df, model).collect())


def brute_language(data, text):
    """Log weights of each language: counts, smoothing and back-off written out."""
    languages = sorted({l for _, l in data})
    counts = {l: Counter(w for t, m in data if m == l for w in t.split()) for l in languages}
    words = {w for l in languages for w, n in counts[l].items() if n > 1}
    known = {l: {w: n for w, n in counts[l].items() if n > 1} for l in languages}
    grams = {n: {l: Counter() for l in languages} for n in range(1, 6)}
    for l in languages:
        for w, k in known[l].items():
            for n in grams:
                marked = f" {w} " if n > 1 else w
                for i in range(len(marked) - n + 1):
                    grams[n][l][marked[i : i + n]] += k
    total = dict.fromkeys(languages, 0.0)
    for w in text.split():
        if w in words:
            for l in languages:
                total[l] += np.log((known[l].get(w, 0) + 0.1) / (sum(counts[l].values()) + 0.1 * len(words)))
            continue
        for n in range(5, 0, -1):
            marked = f" {w} " if n > 1 else w
            seen = set().union(*(grams[n][l] for l in languages))
            found = [g for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in seen]
            if found:
                for l in languages:
                    total[l] += sum(np.log((grams[n][l][g] + 0.1) / (sum(grams[n][l].values()) + 0.1 * len(seen))) for g in found)
                break
    return languages, total


def test_language_scores_by_hand(spark):
    rnd = random.Random(29)
    data = [(" ".join("".join(rnd.choice("abcd" if l == "p" else "bcde" if l == "q" else "cdef") for _ in range(rnd.randrange(1, 6))) for _ in range(12)), l) for l in "pqr" * 12]
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(data)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    learned = [x for i, x in enumerate(data) if zlib.crc32(str(i).encode()) % 3 != 1]
    for t, _ in data + [("fed abcdef zzz", "p")]:
        languages, total = brute_language(learned, t)
        weights = np.exp(np.array([total[l] for l in languages]) - max(total.values()))
        lang, score = model.predict(t)
        assert abs(score - weights.max() / weights.sum()) < 1e-9 and lang == languages[int(weights.argmax())]


def test_unseen_words_back_off_to_shorter_grams():
    spellings, columns, counts = pa.array([" ab", "c", "c"]), np.array([0, 0, 1]), np.array([9, 1, 9])
    table = langid.Table.of(spellings, columns, counts, np.array([2, 0, 0]), [np.array([10, 10]), np.array([1, 1]), np.array([9, 9])])
    model = langid.Model(["a", "b"], None, table)
    assert model.predict("ab")[0] == "a" and model.predict("xcx")[0] == "b"


# ---- 8 substring dedup

def brute_repeats(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            w = byte_words(t)
            for j in range(len(w) - 12):
                k = tuple(w[j : j + 13])
                first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, t in rows:
        w = byte_words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        out[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [substrings.HOT_WORDS, 1])
def test_substrings(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_WORDS", hot)
    got = substrings.remove_repeats(docs)
    assert gathered(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)
    assert substrings.remove_repeats(empty).count() == 0


def test_many_repeated_rows(spark):
    text = " ".join(f"r{i}" for i in range(40))
    df = spark.range(100_000).select((F.col("id") % 2).alias("doc_id"), F.lit(text).alias("text"))
    got = gathered(substrings.remove_repeats(df), "doc_id", "n_words", "n_removed")
    assert got == {(0, 40, 0): 50_000, (1, 40, 40): 50_000}


def test_automaton():
    rnd = random.Random(17)
    for _ in range(200):
        passages = sorted((rnd.randrange(5), [rnd.choice([b"a", b"b"]) for _ in range(rnd.randrange(3, 14))]) for _ in range(6))
        got = substrings.stream_shard([(b" ".join(w), k) for k, w in passages], 3)
        for (k, w), firsts in zip(passages, got):
            assert firsts == [min(k2 for k2, v in passages if any(v[x : x + 3] == w[j : j + 3] for x in range(len(v) - 2))) for j in range(len(w) - 2)]


def test_kept_text_and_removed_spans(docs, rows, empty):
    got, some = Counter(), 0
    for r in substrings.cut_repeats(docs).collect():
        t = dict(rows)[r["doc_id"]] if r["doc_id"] is not None else None
        gone = [(p["start"], p["length"]) for p in r["removed"]]
        some += len(gone)
        if t is not None:
            w = t.encode().split()
            assert len(w) == r["n_words"]
            cover = {i for a, n in gone for i in range(a, a + n)}
            assert r["kept"].encode() == b" ".join(x for i, x in enumerate(w) if i not in cover) and all(n > 0 for _, n in gone)
        got[r["doc_id"], r["n_words"], sum(n for _, n in gone), hashlib.sha256(r["kept"].encode()).hexdigest()] += 1
    assert some and got == brute_repeats(rows)


# ---- 9 near duplicates

def brute_fingerprint(t, size=3):
    w = (t or "").encode().lower().split()
    found = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(fps, keys, linked):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if linked(fps[i], fps[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("tile,small", [(simhash.TILE, simhash.SMALL), (2, 1), (5, 0)])
def test_simhash(docs, rows, empty, tile, small, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SMALL", small)
    fps = [brute_fingerprint(t) for _, t in rows]
    classes = brute_components(fps, [i for i, _ in rows], lambda a, b: bin(a ^ b).count("1") <= 3)
    want = Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, classes))
    assert gathered(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    if tile == simhash.TILE:
        assert simhash.near_duplicates(empty).count() == 0


def test_comparer_links_are_exact():
    rnd = np.random.default_rng(19)
    base = rnd.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.concatenate([base, *(base ^ (np.uint64(1) << rnd.integers(0, 64, 60).astype(np.uint64)) for _ in range(3))])
    order = np.bitwise_count(fps).astype(np.int64)
    at = np.lexsort((fps, order))
    fps, order = fps[at], order[at]
    label = simhash.Comparer(3, 3, None).forest(np.zeros(240, dtype=int), np.zeros(240, dtype=int), order, fps.reshape(-1, 1))
    want = brute_components(fps.tolist(), list(range(240)), lambda a, b: bin(a ^ b).count("1") <= 3)
    assert label.tolist() == want


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {i: 0 for i in range(1, n + 1)} | {101: 100}


def test_keep_one_of_each(docs, rows, empty):
    out = simhash.keep_one_of_each(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    sets = [(i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)) if w)) for i, t in rows for w in [(t or "").lower().encode().split()]]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, s in sets:
        twins = [j for j, u in sets if j is not None and like(s, u) >= 0.8]
        if i is not None and min(twins) == i and all(like(s, u) < 0.6 for j, u in sets if j not in twins and j is not None):
            assert i in kept
        if i in kept and i is not None:
            assert not [j for j in twins if j in kept and j != i]
    assert simhash.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("tile,small", [(1024, 24), (16, 4)])
def test_near_copies_are_linked_by_exact_similarity(spark, tile, small, monkeypatch):
    """Pairs of chosen similarity around 0.8, each in words of its own: linked at 0.8 and above, never below."""
    monkeypatch.setattr(simhash, "SET_TILE", tile, raising=False)
    monkeypatch.setattr(simhash, "WIDE_TILE", 16 * tile)
    monkeypatch.setattr(simhash, "SMALL", small)
    texts, gone = [], set()
    for pair in range(400):
        n = (8, 60, 200, 401)[pair % 4]
        first = [f"p{pair}w{i}" for i in range(n + 4)]  # n shingles, the last of which a change of the last words replaces
        same = n - round(n * (1 - (0.79, 0.8, 0.81, 0.75, 0.7)[pair // 4 % 5]) / (1 + (0.79, 0.8, 0.81, 0.75, 0.7)[pair // 4 % 5]))
        second = first[: same + 4] + [f"p{pair}x{i}" for i in range(n - same)]
        if same / (2 * n - same) >= 0.8:
            gone.add(2 * pair + 1)
        texts += [(2 * pair, " ".join(first)), (2 * pair + 1, " ".join(second))]
    # a chain and a large group: each next text drops one shingle in the front and has one more at the end
    line = [f"c{i}" for i in range(400)]
    texts += [(1000 + i, " ".join(line[i : i + 104])) for i in range(120)]
    gone |= set(range(1001, 1120))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()}
    assert {i for i, _ in texts} - kept == gone


# ---- 10 sharding

def test_sharding(docs, rows, empty):
    got = sharding.assign_shards(docs, 7).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 7) and 0 <= r["shard"] < 7 and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty, 7).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 40, 200])
def test_jump_hash_moves_little_and_is_even(spark, shards):
    rows = spark.range(6000).select(sharding.jump_hash(F.col("id"), shards).alias("a"), sharding.jump_hash(F.col("id"), shards + 1).alias("b")).collect()
    moved = [r for r in rows if r["a"] != r["b"]]
    assert all(r["b"] == shards for r in moved)
    assert abs(len(moved) / 6000 - 1 / (shards + 1)) < 0.03
    counts = Counter(r["a"] for r in rows)
    assert max(counts.values()) < 6000 / shards + 6 * (6000 / shards) ** 0.5 + 1
