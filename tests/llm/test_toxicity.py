import numpy as np
import pytest

from entiforge.llm import toxicity as tx

CLEAN = ["How do I sort the index in Java without touching the cache?", "Our team of 12 people maintains a legacy parser.", "Kill the zombie child before the parent process dies.", "My filter flags the word idiot inside logs.", "Sorry for the stupid question, I feel like an idiot for missing the lock.", "The column sex holds only two codes."]
TOXIC = ["You are a complete idiot and nobody here wants you.", "Shut up, you moron.", "Foreigners are vermin and should be driven out.", "Never hire women, they are all thieves.", "I am so horny, send me your nudes.", "I would love to undress you and have sex with you."]


def test_disguises():
    m = tx.Model(np.zeros(tx.DIM), telling={"idiot": 1.0})
    for s in ("i d i o t", "i.d.i.o.t", "1d1ot", "id​iot", "IDIOT", "idddiot", "i***t", "idoit", "іdіоt", "a i d i o t"):
        assert "idiot" in [m.undisguise(w) for w in tx.sentence_words(f"you {s} there")], s
    assert tx.sentences(None) == tx.sentences("") == [] and len(tx.sentences("A b. C d!\nE")) == 3


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(0)
    posts = [(i, f"{CLEAN[i // 6 % 6]} {TOXIC[i % 6]}", "abuse") for i in range(60)] + [(100 + i, f"{CLEAN[i % 6]} {CLEAN[(i + 1) % 6]}", "none") for i in range(60)] + [(300, None, "abuse"), (301, "x", None)]
    docs = [(i, " ".join(CLEAN[j] for j in rng.integers(0, 6, 4)), "s1", 0.5) for i in range(300)]
    docs += [(1000 + i, f"{CLEAN[i % 6]}\n{t}", "s2", 0.5) for i, t in enumerate(["You are a complete 1d1ot and nobody here wants you!", "Foreigners are thieves and should be driven out.", "I am so h o r n y, send me your nudes now."])]
    docs += [(2000, None, None, 0.5), (2001, "", "s2", 0.5), (2002, CLEAN[0] * 2000, "s2", 0.5)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score double")
    r = spark.createDataFrame(posts, "sample_id bigint, post_text string, verdict string")
    return d, r, tx.fit(r, d)


def test_unseen_statements(model):
    d, _, fitted = model
    got = {r.doc_id: r for r in tx.score_documents(d, fitted).collect()}
    assert len(got) == 306 and got[2000].score == 0 and got[2000].n_windows == 0 and got[2001].n_windows == 0
    worst = sorted(got.values(), key=lambda r: -r.score)[:3]
    assert {r.doc_id for r in worst} == {1000, 1001, 1002} and got[2000].toxic_windows == got[2001].toxic_windows == 0
    assert all((r.score > 0.5) == (r.toxic_windows > 0) for r in got.values())


def test_held_out_posts(model):
    _, _, fitted = model
    assert (fitted.positive > fitted.harmless.max()).mean() > 0.9


def test_rates(model):
    d, _, fitted = model
    scored = tx.score_documents(d, fitted).cache()
    rates = {r.source: (r.n_docs, r.toxic_docs) for r in tx.source_rates(d, scored).collect()}
    assert rates["s1"] == (300, 0) and rates[None] == (1, 0) and rates["s2"][0] == 5


def test_without_posts(model):
    d, r, _ = model
    got = tx.score_documents(d, tx.fit(r.where("verdict = 'none'"), d)).collect()
    assert len(got) == 306 and not any(x.score or x.toxic_windows for x in got)
    assert tx.score_documents(d.where("doc_id < 0"), tx.fit(r, d.where("doc_id < 0"))).count() == 0


def test_best_bin():
    rng = np.random.default_rng(1)
    positive, harmless = rng.normal(3, 1, 4000), rng.normal(-3, 1, 96_000)
    share, _ = tx.best_bin(rng.normal(3, 1, 500), tx.bin_counts(np.r_[positive, harmless]))
    assert 0.03 < share < 0.05


def test_survey_draws_rare_windows_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(tx, "PER_BIN", 5)
    d = spark.createDataFrame([(i, f"{CLEAN[i % 6]} Row {'abcdefgh'[i % 8]} holds.") for i in range(3000)] + [(5000, "You utter dimwit."), (5001, "You utter dimwit."), (5002, None)], "doc_id bigint, text string").repartition(7)
    models = [tx.Model(np.zeros(tx.DIM), telling={}) for _ in range(2)]
    for m in models:
        m.weights[tx._slot("w dimwit")] = 8.0
        m.weights[-1] = -3.0
    docs, rows, drawn, sure = tx.survey(tx.window_table(d), models, tx.usual_pairs([tx.sentence_words(CLEAN[0])]), 1.0, 0.0)
    assert docs.sum() == 3002 and rows.sum() == sum(len(tx.cut_up(r.text)) for r in d.collect())
    assert [r.window for r in sure] == ["you utter dimwit"] and "you utter dimwit" in {r.window for r in drawn}
    z, _ = tx.Scorer(np.stack([m.weights for m in models], axis=1), {})(["you utter dimwit", "kill the zombie child"])
    assert np.allclose(z[:, 1], [models[0].margin(w) for w in (["you", "utter", "dimwit"], ["kill", "the", "zombie", "child"])])


def test_unseen_kinds_join_by_what_they_share(spark):
    telling, m = {f"w {w}" for w in ("vark", "blen", "dorf", "odd")}, tx.Model(np.zeros(tx.DIM), telling={})
    telling = {tx.zlib.crc32(t.encode()) for t in telling} | {tx.zlib.crc32(b"m hidden")}
    unseen = [f"we must be rid of {w} for good" for w in ("vark", "blen", "dorf")]
    chance = [f"name the odd one {w} twice" for w in ("under rain", "at noon", "by light")]
    hidden = " ".join(tx.sentence_words("show me your z o r k"))
    others = ["show me your zork", "show me your list"]
    rows = [tx.pd.Series({"window": w}) for w in [*unseen, *chance, hidden, *others]]
    got = tx.supported(rows, {w: 1.0 for w in [*unseen, *chance, *others]}, set(), telling, m)
    assert got == {*unseen, hidden, "show me your zork"}


def test_survey_counts_company(spark):
    d = spark.createDataFrame([(i, f"Row {'abcd'[i % 4]} holds. The dimwit sleeps.") for i in range(40)] + [(90, "You dimwit.")], "doc_id bigint, text string").repartition(3)
    m = tx.Model(np.zeros(tx.DIM), telling={})
    m.weights[tx._slot("w you")] = 8.0
    hashes = {w: tx.zlib.crc32(f"w {w}".encode()) for w in ("dimwit", "you", "holds")}
    company = tx.Company(np.array(sorted(hashes.values())), np.array([hashes["dimwit"]]))
    _, _, _, found = tx.survey(tx.window_table(d), [m], tx.usual_pairs([]), 1.0, 1.0, company)
    assert {r.window for r in found if r.kind == "kin"} == {"the dimwit sleeps", "you dimwit"}
    assert dict(zip(company.features.tolist(), company.held.sum(axis=1))) == {hashes["dimwit"]: 41, hashes["you"]: 1, hashes["holds"]: 40}
    assert company.keep(1.0, least=1).tolist() == [hashes["you"]]


def test_limit_in_the_valley():
    counts = np.zeros(len(tx.BINS) - 1)
    counts[:160], counts[160:170], counts[190:230] = 500, 15, 10
    fitted = tx.Fitted(tx.Model(np.zeros(tx.DIM)), np.linspace(0, 2, 50), np.full(20, -8.0))
    assert tx.BINS[170] < tx.statement_limit(fitted, counts, valley=True) < tx.BINS[190]
