import random
import re

from panelwright.llm import passage_dedup as pd_

from . import corpus


M = (1 << 64) - 1
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_hash(word, before):
    """Of a word and the one before, by plain integers."""

    def mix(w):
        m = len(w)
        for i in range(4):
            m = (m * 0x9E3779B97F4A7C15 + w[max(len(w) - 1 - i, 0)]) & M
            m = (m * 0x9E3779B97F4A7C15 + w[min(i, len(w) - 1)]) & M
        return m

    h = (mix(word) + (mix(before) if before else 0) * 0x9E3779B97F4A7C15 + 4 * 0x9E3779B97F4A7C15) & M
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M
    return h ^ h >> 31


def plain_units(text, clauses):
    """(kind, words joined, number of the first word, number of words, first byte, last byte), word by word."""
    words, out, before, at = [], [], None, 0
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", text):
        w = m[0].decode().translate(LOW).encode()
        gap = text[at : m.start()].count(b"\n") if words else 0
        words.append((m.start(), m.end(), w, gap, plain_hash(w, before if gap < 2 else None)))
        before, at = w, m.end()
    for kind in range(1 + clauses):
        ends = {len(words) - 1} | {i - 1 for i in range(1, len(words)) if words[i][3] > kind}
        if kind:
            borders = [0, *sorted(e + 1 for e in ends)]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                for i in range(a, b - pd_.WITHIN + 1):
                    least = min(words[j][4] for j in range(i, i + pd_.WITHIN))
                    ends |= {j for j in range(i, i + pd_.WITHIN) if words[j][4] == least}
        begin = 0
        for e in sorted(ends) if words else ():
            own = words[begin : e + 1]
            out.append((kind, b" ".join(w[2] for w in own), begin, len(own), own[0][0], own[-1][1]))
            begin = e + 1
    return out


def by_units(rows, unit, min_words):
    """Spans to remove by the definition, over units found word by word."""
    own = sorted({(d[0], d[1] or "") for d in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    first, marked = {}, {}
    for d in own:
        for kind, key, place, n, a, b in sorted(plain_units(d[1].encode(), unit == "clause"), key=lambda u: u[2]):
            if first.setdefault((kind, key), (d, place)) != (d, place):
                marked.setdefault(d, []).append((place, n, a, b))
    out = set()
    for d, found in marked.items():
        gone = {w for place, n, _, _ in found for w in range(place, place + n)}
        starts, ends = {u[0]: u[2] for u in found}, {u[0] + u[1]: u[3] for u in found}
        for w in sorted(gone):
            if w - 1 not in gone:
                e = w
                while e in gone:
                    e += 1
                if e - w >= min_words:
                    out.add((d[0], starts[w], ends[e], e - w))
    return out


def passage(r, n):
    return " ".join("p%x" % r.getrandbits(28) for _ in range(n))


def planted(seed=1):
    r = random.Random(seed)
    rows = [(1000 + i, passage(r, r.randint(5, 200)), "en", "s", 0, 0, 0.0, 0, "") for i in range(40)]
    shared = [passage(r, 60) for _ in range(3)]
    for i, p in enumerate(shared):
        for j in range(4):
            rows.append((2000 + 10 * i + j, f"{passage(r, 17 + j)} {p.upper() if j % 2 else p} {passage(r, 9 + j)}", "en", "s", 0, 0, 0.0, 0, ""))
    return rows


def test_equals_definition(spark):
    rows = [r for r in corpus.rows() if r[0] != 5] + planted()
    for unit, n in (("clause", 20), ("line", 3), ("line", 1), ("clause", 1)):
        got = pd_.repeated_spans(corpus.docs(spark, rows), unit, n).collect()
        assert {(r.doc_id, r["first"], r["last"], r.words) for r in got} == by_units(rows, unit, n)


def test_finds_passages_inside_lines_and_leaves_the_rest(spark):
    rows = planted()
    docs = corpus.docs(spark, rows)
    spans = pd_.repeated_spans(docs)
    got = {r.doc_id: r for r in pd_.span_lists(docs, spans).collect()}
    assert len(got) == len(rows)
    for d in rows:
        repeat = d[0] >= 2000 and d[0] % 10 > 0
        assert (got[d[0]].n_spans > 0) == repeat
        if repeat:
            assert got[d[0]].kept_docs == [d[0] // 10 * 10] and got[d[0]].words_removed >= 20


def test_offsets_and_removal(spark):
    rows = [r for r in corpus.rows() if r[0] is not None and r[0] != 5] + planted(2)
    docs = corpus.docs(spark, rows)
    own = {d[0]: (d[1] or "").encode() for d in rows}
    for r in pd_.remove_spans(docs, pd_.repeated_spans(docs)).collect():
        left, at = b"", 0
        for s in r.spans or []:
            left += own[r.doc_id][at : s["first"]]
            at = s["last"]
        assert r.text.encode() == left + own[r.doc_id][at:]


def test_repeated_lines_go_at_any_length(spark):
    rows = [r for r in corpus.rows() if r[0] is not None and r[0] != 5] + planted(4)
    rows += [(i, f"Read more\n{passage(random.Random(i), 30)}\n  read  MORE \nBye {i}", "en", "s", 0, 0, 0.0, 0, "") for i in range(3000, 3004)]
    docs = corpus.docs(spark, rows)
    got = pd_.repeated_spans(docs, short_lines=True).collect()
    passages = {(r.doc_id, r["first"], r["last"], r.words) for r in got if r.passage}
    assert passages == by_units(rows, "clause", 20)
    # each repeated line is gone, by itself or within a passage; nothing else is
    lines = set()
    seen = {}
    for d in sorted({(r[0], r[1] or "") for r in rows}):
        for _, key, place, n, a, b in plain_units(d[1].encode(), False):
            if seen.setdefault(key, (d, place)) != (d, place) and not any(p[0] == d[0] and p[1] <= a and b <= p[2] for p in passages):
                lines.add((d[0], a, b, n))
    assert {(r.doc_id, r["first"], r["last"], r.words) for r in got if not r.passage} == lines
    lists = {r.doc_id: r for r in pd_.span_lists(docs, pd_.repeated_spans(docs, short_lines=True)).collect()}
    assert [len(lists[i].line_spans) for i in range(3000, 3004)] == [1, 2, 2, 2] and lists[3001].n_spans == 0 and lists[3001].line_words == 4
    left = {r.doc_id: r.text for r in pd_.remove_spans(docs, pd_.repeated_spans(docs, short_lines=True)).collect()}
    assert left[3002].lower().count("more") == 0 and "Bye 3002" in left[3002] and "Read more" in left[3000]


def test_cuts_do_not_depend_on_what_stands_around():
    r = random.Random(3)
    p = passage(r, 80).encode()
    a, b, _, _ = pd_.units(p)[1]
    inner = {p[x:y] for x, y in zip(a, b, strict=True)}
    wide = b"some words go first " + p + b" and some last"
    c, d, _, _ = pd_.units(wide)[1]
    shared = inner & {wide[x:y] for x, y in zip(c, d, strict=True)}
    assert sum(len(u.split()) for u in shared) >= 80 - 2 * pd_.WITHIN - 1


def test_every_repeat_of_fifty_words_shares_twenty():
    r = random.Random(8)
    for n in range(200):
        p = passage(r, 50) if n % 2 else " ".join(r.choice(["the", "of", "and", "ing"]) for _ in range(50))
        found = []
        for k in range(2):
            if n % 3 == 0:  # wrapped anew in each place
                p = "".join("\n" if c in " \n" and r.random() < 0.1 + 0.2 * k else " " if c == "\n" else c for c in p)
            text = f"{passage(r, r.randrange(40))} {p} {passage(r, r.randrange(40))}".encode()
            a, b, _, w = pd_.units(text)[1]
            found.append([(b" ".join(text[x:y].split()), int(k)) for x, y, k in zip(a, b, w, strict=True)])
        known, best, run = {u for u, _ in found[0]}, 0, 0
        for u, k in found[1]:
            run = run + k if u in known else 0
            best = max(best, run)
        assert best >= 20, (n, best)


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(6)
    text = "".join(r.choice(["w%x" % r.getrandbits(9), "The", "a"]) + r.choice([" "] * 12 + ["\n", " \n\n", "\t"]) for _ in range(8000)).encode()
    monkeypatch.setattr(pd_, "PIECE", 700)
    monkeypatch.setattr(pd_, "AROUND", 400)
    got = [(kind, *map(int, u)) for kind, cols in enumerate(pd_.units(text)) for u in zip(*cols, strict=True)]
    assert got == [(kind, a, b, place, n) for kind, _, place, n, a, b in plain_units(text, True)]
    assert pd_._digest(text, 1) == pd_.xxhash.xxh3_128_digest(b" ".join(text.split()), 1)


def test_rank_and_empty(spark):
    text = " ".join("w%d" % i for i in range(70))
    docs = spark.createDataFrame([(1, text, 5), (2, text, 1), (3, "short", 0)], "doc_id long, text string, rank long")
    assert [(r.doc_id, r.kept_doc) for r in pd_.repeated_spans(docs, rank="rank").collect()] == [(1, 2)]
    empty = corpus.docs(spark, [])
    assert pd_.span_lists(empty, pd_.repeated_spans(empty)).count() == 0
