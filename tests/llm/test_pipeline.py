"""Every stage of the pipeline against a plain version, on planted rows, and the whole run."""

import math
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import mixing, sentencepiece_viterbi
from gridloom.llm.common import stored
from tests.llm.test_operators import SF, documents, frame, odd_docs, plain_components, plain_profile

STAGES = dict(corpus_pipeline.STAGES)


def planted(spark):
    """Real documents, with copies, near copies, a shared notice, nulls, repeated rows and clashing columns."""
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents(spark).collect()]
    top = max(i for i, *_ in rows) + 1
    prose = [w for _, t, lang, _ in rows if lang == "en" and t for w in t.split()]
    own = lambda n: " ".join(rng.choices(prose, k=n))
    notice = "A notice about this very site that each of them carries below its pages, word by word."
    body = own(200).split()
    rows += [(top + i, own(80) + "\n" + notice, "en", f"site{i % 12}") for i in range(14)]
    rows += [(top + 20 + i, " ".join([*body[:-1], f"end{i}"]), "en", "near") for i in range(6)]
    rows += [rows[0], rows[0], (None, own(60), "en", "s"), (None, None, None, None), (top + 40, "", "en", "s"), (top + 41, "12 34 !!", "en", "s"), (rows[1][0], own(70), "en", "s")]
    return frame(spark, rows).withColumn("row", F.lit("clash")).withColumn("lang_pred", F.lit(1)).withColumn("key", F.lit(2.0))


def as_rows(df):
    return sorted(map(repr, df.collect()))


def plain_languages(rows):
    sums = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1):
            for g, n in plain_profile(r["text"])[1].items():
                own = sums.setdefault(r["lang"], {})
                own[g] = own.get(g, 0) + n
    code = plain_profile("")[2]
    ranks = {lang: {g: n for n, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[:400])} for lang, c in sums.items()}
    kept = []
    for r in rows:
        own = plain_profile(r["text"])[0]
        score = max((1.0 - sum(abs(k[g] - n) if g in k else 400 for n, g in enumerate(own)) / (400 * len(own)) for k in ranks.values()), default=0) if own else -1
        if score >= corpus_pipeline.LEAST_SCORE:
            kept.append(r)
    return kept


def plain_lines(rows):
    bare = lambda x: x.strip(" \t\r\v\f")
    sites = {}
    for r in rows:
        if r["source"] is not None:
            for x in (r["text"] or "").split("\n"):
                sites.setdefault(bare(x), set()).add(r["source"])
    bad = {x for x, s in sites.items() if x and len(s) >= 10}
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if bare(x) not in bad]
        goes = r["text"] is not None and len(kept) < len(lines) and any(map(bare, kept))
        text = "\n".join(kept) if goes else r["text"]
        out.append((r["doc_id"], text, len(text) if goes else r["n_chars"]))
    return out


def test_language_stage(spark):
    docs = planted(spark)
    out = STAGES["language_id"](spark, docs, SF)
    assert out.columns == docs.columns
    assert as_rows(out) == sorted(map(repr, plain_languages(docs.collect()))) and 0 < out.count() < docs.count()


def test_line_stage(spark):
    docs = planted(spark)
    out = STAGES["line_dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    want = plain_lines(docs.collect())
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()))) == sorted(map(repr, want))
    assert sum(n != (len(r["text"]) if r["text"] else 0) for (_, _, n), r in zip(want, docs.collect(), strict=True)) >= 14


def plain_near(rows):
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0, i) for i, r in enumerate(rows)]
    names = plain_components([(i, r["text"]) for i, r in enumerate(rows)], 5, 80)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(names[i][1] if names[i][0] else ("alone", i), []).append(i)
    return groups, ids


def test_near_duplicate_stage(spark):
    docs = planted(spark)
    out = STAGES["ngram_jaccard"](spark, docs, SF)
    assert out.columns == docs.columns
    rows, kept = docs.collect(), out.collect()
    groups, ids = plain_near(rows)
    assert len(kept) == len(groups) < len(rows)
    best = [min((ids[i][:2], rows[i]) for i in g)[0] for g in groups.values()]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept) == sorted(best)


def test_mixing_stage(spark):
    docs = planted(spark)
    out = STAGES["poisson_mix"](spark, docs, SF)
    assert out.columns == docs.columns
    chars, counts = {}, {}
    rows = docs.collect()
    for r in rows:
        chars[r["source"]] = chars.get(r["source"], 0) + len(r["text"] or "")
    weight = {s: math.sqrt(n) for s, n in chars.items()}
    total, all_weights = sum(chars.values()), sum(w for s, w in weight.items() if chars[s])
    for r in out.collect():
        counts[r["doc_id"], r["text"]] = counts.get((r["doc_id"], r["text"]), 0) + 1
    for key in {(r["doc_id"], r["text"]) for r in rows}:
        same = [r for r in rows if (r["doc_id"], r["text"]) == key]
        source = same[0]["source"]
        rate = weight[source] / all_weights * total / chars[source] if chars[source] else 0.0
        import hashlib

        u = int(hashlib.sha256("/".join([mixing.SEED, "draw", "" if key[0] is None else str(key[0])]).encode()).hexdigest()[:13], 16) / 16**13
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        assert counts.get(key, 0) == n * len(same), key[0]


def test_encoding_stage(spark):
    docs = planted(spark)
    codec = sentencepiece_viterbi.codec(public_tokenizers.path("piece_bpe_32k.model"))
    got = STAGES["sentencepiece"](spark, docs, SF).collect()
    assert len(got) == docs.count() and all(r["exact"] and r["n_pieces"] == len(r["ids"]) for r in got)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
    assert all(codec.decode(list(r["ids"])) for r in got if r["n_pieces"]) and sum(r["n_pieces"] == 0 for r in got) == docs.where("coalesce(text, '') = ''").count()
    for r in got[:40]:
        if r["doc_id"] in texts and docs.where(F.col("doc_id") == r["doc_id"]).count() == 1:
            assert codec.decode(list(r["ids"])) == (texts[r["doc_id"]] or "")


@pytest.mark.parametrize("stage", list(STAGES))
def test_stages_over_odd_and_empty_tables(spark, stage):
    assert STAGES[stage](spark, odd_docs(spark).limit(0), SF).count() == 0
    assert STAGES[stage](spark, odd_docs(spark), SF).count() >= 0


def test_run_is_its_stages_one_after_another(spark, tmp_path):
    docs = planted(spark).drop("row", "lang_pred", "key")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = as_rows(corpus_pipeline.run(spark, str(tmp_path)))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stored(stage(spark, now, str(tmp_path)), name)
        assert now.columns == before.columns
    assert found == as_rows(STAGES["sentencepiece"](spark, now, str(tmp_path))) and found
