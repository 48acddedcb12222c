"""WARC salvage, repair of turns and divergence of sources on small fixtures: brute force, round trips, damage."""

import base64
import gzip
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import divergence, queries, turn_repair, warc
from tests.conftest import LARGER, SMALL

PAGES = "page_id long, url string, html string"
TURNS = "conv_id long, turn long, role string, text string"


# 11 WARC


def plain_round_trip(pages):
    """The contract by its words: of equal payloads the largest page_id is the response."""
    by = defaultdict(list)
    for page, url, html in pages:
        by[html or ""].append((page is not None, page or 0, url or "", url is not None, page))
    out = []
    for html, own in by.items():
        own.sort(reverse=True)
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for i, x in enumerate(own):
            out.append((x[-1], len(data), digest, "revisit" if i else "response", own[0][-1] if i else None))
    return sorted(map(str, out))


def test_round_trip_against_its_definition(spark):
    r = random.Random(4)
    bodies = [None, "", "<p>é ß\r\n\r\nWARC/1.1\r\n</p>", "x" * 50_000, "HTTP/1.1 200 OK\r\n\r\nno header", *(f"<p>{i}</p>" for i in range(10))]
    pages = [(i, f"http://h/{i}\r\nX: 1", r.choice(bodies)) for i in range(60)]
    pages += [pages[5], pages[5], pages[9], (9, "other", pages[9][2]), (None, None, "<p>3</p>"), (None, "u", "only without an id"), (None, None, None), (70, None, "y" * 900_000)]
    df = spark.createDataFrame(pages, PAGES).withColumn("digest", F.lit("clash")).withColumn("bytes", F.lit(1)).repartition(5)
    got = sorted(str((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in warc.round_trip(df).collect())
    assert got == plain_round_trip(pages)
    assert warc.round_trip(df.where("false")).count() == 0


@pytest.mark.parametrize("folder", [SMALL, LARGER])
def test_round_trip_against_sql(same, folder):
    same(queries.QUERIES["op11_salvaged_warc"], queries.ORACLE_SQL["op11_salvaged_warc"], folder)


def archive_of(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        payload = "".join(r.choice("abc \r\n") for _ in range(r.randint(0, 300))).encode() + (b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" if i % 5 == 0 else b"")
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
        out.append(f"WARC/1.1\r\nWARC-Type: response\r\nPage-ID: {i}\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    return out


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("kind", ["flip", "cut", "insert", "end"])
def test_what_stands_after_damage_is_read(packed, kind):
    for seed in range(25):
        r = random.Random(seed)
        parts = [gzip.compress(x, mtime=0) if packed else x for x in archive_of(12, seed)]
        hit = 11 if kind == "end" else r.randrange(12)
        at = r.randrange(len(parts[hit]))
        # The headers of a plain archive are under no checksum: they are left as they are.
        if not packed:
            at = r.randrange(parts[hit].index(b"\r\n\r\n") + 4, len(parts[hit]))
            at = r.randrange(10) if kind != "cut" and seed % 3 == 0 else at
        broken = bytearray(parts[hit])
        if kind == "flip":
            broken[at] ^= 0x41
        elif kind == "insert":
            broken[at:at] = bytes(r.randrange(256) for _ in range(40))
        else:
            del broken[at : None if kind == "end" else at + r.randint(1, 60)]
        data = b"".join(parts[:hit]) + bytes(broken) + b"".join(parts[hit + 1 :])
        found = list(warc.salvage(data))
        records = [int(f.headers["page-id"]) for f in found if f.gap is None]
        assert [p for p in records if p != hit] == [p for p in range(12) if p != hit]
        assert records.count(hit) <= 1
        if hit not in records and broken:
            assert any(f.gap for f in found)
        # Every byte has its place.
        at = 0
        for f in found:
            assert f.offset == at
            at += f.length
        assert at == len(data)


def test_gaps_are_logged(spark, tmp_path):
    parts = archive_of(6)
    (tmp_path / "a.warc").write_bytes(b"junk" * 100 + b"".join(parts[:3]) + parts[3][:-30] + b"".join(parts[4:]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts[:2]) + b"\x1f\x8b\x08 no member" + gzip.compress(parts[5]))
    (tmp_path / "c.warc").write_bytes(b"nothing of the kind")
    (tmp_path / "d.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    pages = defaultdict(list)
    gaps = defaultdict(list)
    for r in sorted(got, key=lambda r: r.offset):
        name = r.archive.rsplit("/", 1)[1]
        if r.gap is None:
            pages[name].append(r.page_id)
            assert parts[r.page_id].endswith(bytes(r.payload) + b"\r\n\r\n") and r.payload_bytes == len(r.payload)
        else:
            gaps[name].append((r.offset, r.length))
    assert pages == {"a.warc": [0, 1, 2, 4, 5], "b.warc.gz": [0, 1, 5]}
    before = sum(map(len, parts[:3]))
    assert gaps["a.warc"] == [(0, 400), (400 + before, len(parts[3]) - 30)]
    assert len(gaps["b.warc.gz"]) == 1 and gaps["b.warc.gz"][0][1] == 13
    assert gaps["c.warc"] == [(0, 19)]


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200_000)
    pages = spark.createDataFrame([(i, "u", "z" * 1000 + str(i)) for i in range(2000)] + [(5000, "u", "w" * 400_000)], PAGES).coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    sizes = sorted(f.stat().st_size for f in (tmp_path / "a").glob("part-*"))
    assert len(sizes) > 10 and sizes[-2] < 400_000 and sizes[-1] < 402_000
    assert warc.read_archives(spark, str(tmp_path / "a"), payloads=False).where("gap is null").count() == 2001


# 12 repair of turns


def cheapest(rows_):
    """Cost and least audit by a search over (row, role given out last) that keeps the least (cost, audit)."""
    state_next = {"": "u", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows_) and state in ("", "a"):
            return cost, audit
        heapq.heappush(queue, (cost + 5, audit + "I", i, state_next[state]))
        if i == len(rows_):
            continue
        role, fault = rows_[i]
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state))
        if fault not in "bd":
            cut = 5 if fault == "t" else 0
            heapq.heappush(queue, (cost + 1 + cut, audit + "R", i + 1, state_next[state]))
            if role == state_next[state] or role == "s" and state == "":
                heapq.heappush(queue, (cost + cut, audit + "K", i + 1, role))
    raise AssertionError


def test_edits_against_a_search():
    r = random.Random(2)
    for _ in range(3000):
        n = r.randint(0, 12)
        rows_ = [(r.choice("suuaao"), r.choice("---bdt")) for _ in range(n)]
        if r.random() < 0.5:  # runs
            rows_ = [x for x in rows_ for _ in range(r.randint(1, 5))][:20]
        text = "".join(chr(65 + turn_repair.SYMBOLS.index(x)) for x in rows_)
        for size in (3, 50):
            blocks = [text[i : i + size] for i in range(0, len(text), size)]
            made = [turn_repair.block_edits(b, (0,) if not k else (0, 1, 2, 3)) for k, b in enumerate(blocks)]
            assert turn_repair.conversation_edits([m[0] for m in made], [m[1] for m in made]) == cheapest(rows_), rows_


def test_long_runs_take_few_steps():
    calls = turn_repair._letters.cache_info().misses
    _, audits = turn_repair.block_edits("I" * 1_000_000, (0,))
    assert len(audits[3]) >= 1_000_000
    assert turn_repair._letters.cache_info().misses - calls < 5_000


def plain_repair(conversations, originals):
    """The contract row by row."""
    out = []
    by = defaultdict(list)
    for row in conversations:
        by[row[0]].append(row)
    for conv in originals:
        own = sorted(by[conv], key=lambda x: (x[1] is not None, x[1] or 0, x[2], hashlib.sha256(x[3].encode()).hexdigest()))
        seen, rows_, counts = set(), [], Counter()
        for _, _, role, text in own:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "b" if not last else "d" if (role, text) in seen else "-" if last in ".!?" else "t"
            seen.add((role, text))
            counts[fault] += 1
            rows_.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault))
        turns = [x[1] for x in own if x[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows_, rows_[1:], strict=False))
        cost, audit = cheapest(rows_)
        state, kept, at = "", [], iter(own)
        for letter in audit:
            row = None if letter == "I" else next(at)
            if letter == "D":
                continue
            state = row[2][0] if letter == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            kept.append((row[2] if letter == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + (row[3] if row else ""))
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def plain_damage(conversations):
    out = []
    for conv, turn, role, text in conversations:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def odd_conversations():
    r = random.Random(8)
    out = []
    for conv in [*range(60), None]:
        for turn in range(r.randint(1, 9)):
            text = r.choice([None, "", " \n", "Same words.", f"Text {r.random()}.", "no end", "Fine! \t", "x" * 3000 + "?"])
            out.append((conv, r.choice([turn, turn, turn, None, turn * 3]), r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), text))
    return [*out, *out[:9], (77, None, "user", "Hi."), (78, 5, "user", None)]


def test_repair_against_its_definition(spark, monkeypatch):
    given = odd_conversations()
    df = spark.createDataFrame(given, TURNS).withColumn("n", F.lit(1)).withColumn("kind", F.lit("clash")).repartition(4)
    want = plain_repair(plain_damage(given), {x[0] for x in given})
    for block in (2, 4096):
        monkeypatch.setattr(turn_repair.repair_plan, "__defaults__", (None, block))
        got = turn_repair.repair(turn_repair.damaged(df), df)
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert turn_repair.repair(turn_repair.damaged(df.where("false"))).count() == 0


def test_the_query_on_whole_tables(spark):
    for folder in (SMALL, LARGER):
        given = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        got = queries.QUERIES["op12_turn_repair"](spark, folder).collect()
        assert sorted(str(tuple(r)) for r in got) == plain_repair(plain_damage(given), {x[0] for x in given})


def test_repaired_turns_are_what_is_hashed(spark):
    df = spark.createDataFrame(odd_conversations(), TURNS)
    digests = {r.conv_id: r.repaired_sha256 for r in turn_repair.repair(df, df).collect()}
    made = defaultdict(list)
    for r in turn_repair.repaired_turns(df, df).collect():
        made[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    for conv, digest in digests.items():
        own = sorted(made[conv])
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert hashlib.sha256("\n".join(t for _, t in own).encode()).hexdigest() == digest


# 13 divergence of sources


def plain_divergence(docs, keep=3, top=200):
    """The contract with Python's whole numbers."""
    counts, in_docs, total, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts[lang, source].update(found)
        total[lang].update(found)
        in_docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= keep]
        n_lang = sum(total[lang][t] for t in kept)
        share = lambda n, total, kept=kept: 1 + 10**9 * (n + 1) // (total + len(kept))
        own = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][x] for x in kept)) for t in kept} for x, s in groups if x == lang}
        for s, p in own.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in own.items() if o != s]
            terms = []
            for t in kept:
                q = share(total[lang][t], n_lang)
                if counts[lang, s][t] and p[t] > q:
                    terms.append(((p[t] - q) ** 2 // q, t))
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(map(str, out))


def odd_documents():
    r = random.Random(3)
    words_ = ["the", "The", "é", "Straße", "x1y", "日本", "zz", "A", *(f"w{chr(97 + i)}" for i in range(26))]
    out = [(" ".join(r.choices(words_, k=r.randint(0, 30))), r.choice(["en", "de"]), r.choice(["s1", "s2", "s3", "s4", "hot", "hot", "hot"])) for _ in range(150)]
    return [*out, *out[:10], (None, "en", "s1"), ("", "fr", "a"), ("12 34", "fr", "b"), ("one two", None, None), ("x " * 5000, "en", "hot"), ("only here", "it", "z"), ("tie one", "it", "y")]


@pytest.mark.parametrize("digest", [divergence.digest_of, lambda t: divergence.digest_of(t) % 7, lambda t: 1])
def test_divergence_against_its_definition(spark, digest):
    docs = odd_documents()
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumn("part", F.lit("clash")).withColumn("i", F.lit(1)).repartition(5)
    for top in (200, 3):
        got = divergence.divergence(df, top=top, digest=digest).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(str(tuple(r)) for r in got) == plain_divergence(docs, top=top)
    assert divergence.divergence(df.where("false")).count() == 0


@pytest.mark.parametrize("mix", [divergence._MIX, np.uint64(0)])
def test_terms_are_told_apart_by_all_their_bytes(monkeypatch, mix):
    """Terms of any length, with a hash that has all terms of 9 to 256 bytes alike as well."""
    monkeypatch.setattr(divergence, "_MIX", mix)
    rng = random.Random(5)
    terms = ["".join(rng.choices("ab\xe9", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 200, 256, 257, 600]))).encode()[:600] for _ in range(300)]
    terms += [t[:-1] + b"z" for t in terms] + rng.choices(terms, k=400)
    data = b" ".join(terms)
    ends = np.cumsum([len(t) + 1 for t in terms]) - 1
    starts = ends - np.array([len(t) for t in terms])
    number, places = divergence._told_apart(data, starts, ends)
    assert len(places) == len(set(terms)) and [terms[places[i]] for i in number] == terms


def test_tiles_blocks_and_parts_of_counts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 5)
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 16)
    docs = odd_documents()
    got = divergence.divergence(spark.createDataFrame(docs, "text string, lang string, source string")).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_divergence(docs)


def test_divergence_against_sql(same):
    same(queries.QUERIES["op13_source_divergence"], queries.ORACLE_SQL["op13_source_divergence"])


def test_shares_are_exact_beyond_64_bits(spark):
    n, total = 10**15 + 7, 9 * 10**17 + 11
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // total


def test_texts_stay_behind_until_terms_are_kept(spark):
    """The shuffle of counts by source has no term in it, and a term's text is passed on once for a language, not for each source."""
    docs = spark.createDataFrame([("one two two", "en", s) for s in "abcdefgh"], "text string, lang string, source string").coalesce(1)
    counted = divergence.scratch(divergence.term_counts(docs))
    assert counted.where("n > 0").count() == 16 and counted.where("term is not null").count() == 2 and counted.where("n is not null and term is not null").count() == 0
    plan = counted.where("n is not null").groupBy("lang", "source", "digest").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert "term" not in plan
