import os
import random

import pytest
from pyspark.sql import functions as F

from varloom.llm import bpe
from varloom.llm.bpe import Encoder, Transducer, Utf8Machine, decode, decode_ids, encode_texts, load_ranks
from varloom.llm.language import Detector, Filters, label_code, language_segments, units, wrong_labels
from varloom.llm.leaks import Index, Words, cleaned_documents, find_leaks, leaked_spans, remove_spans

FOLDER = bpe.TOKENIZERS
needs_files = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.tiktoken"), reason="no public vocabularies")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(f"{FOLDER}/byte_bpe_50k.tiktoken")


def texts():
    rng = random.Random(1)
    pool = "ab cAE'st\n\t 0129é—ß⁠中🧬 "
    yield from ["", " ", "a", "don't we'll", "<|endoftext|>", "a" * 3000, " " * 2000, "ACGT" * 500, "".join(rng.choice("ACGT") for _ in range(5000)), "🧬" * 50]
    for _ in range(300):
        yield "".join(rng.choice(pool) for _ in range(rng.randint(0, 120)))


@needs_files
def test_encoding_equals_the_library(ranks):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    small = Encoder(ranks, max_states=50, max_units=20)  # caches that are emptied all the time
    enc = Encoder(ranks)
    for t in texts():
        want = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t).tolist() == want == small.encode(t).tolist()
        assert decode(want, enc.fst.bytes_of) == t
    assert enc.encode(None).tolist() == []


def test_transducer_equals_merging_by_definition():
    rng = random.Random(2)
    for seed in range(30):
        r = random.Random(seed)
        ranks = {bytes([b]): b for b in range(256)}
        words = [b"a", b"b", b"c"]
        for _ in range(25):
            w = r.choice(words) + r.choice(words)
            if w not in ranks and len(w) < 12:
                ranks[w] = len(ranks)
                words.append(w)
        fst = Transducer(ranks, max_states=20)
        # tokens that merging does not build from their own bytes are never produced by either
        for _ in range(40):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40)))
            from array import array

            out = array("i")
            fst.encode(data, out)
            assert [fst.bytes_of[i] for i in out] == fst._merge(data)
    with pytest.raises(ValueError):
        Transducer({b"a": 0})


def test_utf8_machine():
    good = "aé中🧬\u0000"
    for step in (1, 2, 3, 7):
        m, b = Utf8Machine(), good.encode()
        assert "".join(m.feed(b[i : i + step]) for i in range(0, len(b), step)) + m.close() == good
    for raw in (b"\xff", b"a\xe4\xb8", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf5a", b"\xe4\xb8a", b"\xf0\x9f\xa7", b"\x80\x80"):
        m = Utf8Machine()
        assert m.feed(raw) + m.close() == raw.decode("utf-8", "replace"), raw


@needs_files
def test_encoding_frames(spark, ranks):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 20000, "x"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_texts(df)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert out.count() == 5 and got[2] == got[3] == [] and got[1] == [31373, 995]
    back = {r.doc_id: r.text for r in decode_ids(out).collect()}
    assert back == {1: "hello world", 2: "", 3: "", 4: "a" * 20000}
    assert encode_texts(df.limit(0)).count() == 0
    multi = load_ranks(f"{FOLDER}/byte_bpe_multi_50k.tiktoken")
    e = Encoder(multi)
    assert decode(e.encode("Привет, мир"), e.fst.bytes_of) == "Привет, мир"


P1 = "When ranks at Jasce fell below 6716, each coarse batch was stored twice under Hirmur terms. Which markers would retain the dense blocks reported for Semyst after 717 distal rounds? All notes end with this standing line."
P2 = "Quonav-type batches were trimmed with broad panels, whereas Jasulk-type baselines kept 1478 lifted signals. All notes end with this standing line."
P3 = "Both Fenhir and Vortav report balanced panels, yet 7801 covariates linked there were trimmed. Of 7828 traits merged by Guljasgul, the nested ones explain 91 per mille of Rudpriolt tables."
ITEMS = [(1, P1), (2, P2), (3, P3)] + [(10 + i, f"Item {n} speaks of the common ranks and panels below each batch {n * 7} with {n}wex terms and markers there.") for i, n in enumerate(["ulk", "tav", "zan", "nav"])]


def hits(text):
    return {h.item for h in find_leaks(text, Index(ITEMS), Words())}


def test_leaks_found_and_refused():
    assert hits(f"before. {P1} after") == {1} and hits(P3.upper()) == {3}
    one = "when ranks at jasce fell below 6716 each coarse batch was stored twice under hirmur terms"
    assert hits(f"other words {one} and more") == {1}
    # characters, markup and hyphens
    assert hits(P2.replace("a", "a⁠")) == {2} and hits(P2.replace("-type", "type").replace(" ", "\n  ")) == {2}
    assert hits("<b>Quonav</b>-type **batches** were _trimmed_ with &nbsp;broad panels, whereas Jasulk-type baselines kept １４７８ lifted signals") == {2}
    # words changed, lost and added
    assert hits("When rankss at Jasce fell then below 6716, each coarse was stored twice under Hirmur terms. Which markers would also retain the dense reported for Semyst after 717 distal rounds?") == {1}
    # other sentences between
    assert hits(P3.replace("trimmed. ", "trimmed. The file was renamed last week by hand. Nobody knows why it was so. ")) == {3}
    # a short quote, the standing line, and the frame with other names
    assert hits('The term "When ranks at Jasce fell below 6716" is used differently.') == set()
    assert hits("All notes end with this standing line. And nothing else of it.") == set()
    assert hits("When ranks at Oltba fell below 3201, each coarse batch was stored twice under Kelnav terms. Which markers would retain the dense blocks reported for Tavpri after 99 distal rounds?") == set()
    assert hits("") == set()
    # many windows over one long run of a rare word, the passage at its end
    assert hits("so Jasulktype " * 1500 + P2) == {2} and hits("Jasulktype " * 4000) == set()
    far = "word " * 3000
    assert hits(far + P2 + far) == {2}


def test_leak_frames(spark):
    docs = spark.createDataFrame([(1, f"x {P3} y", "q"), (2, None, "q"), (3, "", "q"), (4, "nothing", "q"), (1, f"x {P3} y", "q")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, (99, None), (98, "too short")], "item_id long, passage string")
    s = leaked_spans(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in s.collect()) == [(1, 3), (1, 3)]
    assert {r.text for r in remove_spans(docs.select("doc_id", "text"), s).collect()} == {"x . y"}
    assert sorted((r.doc_id, r.item_id) for r in leaked_spans(docs, items, broadcast_chars=0).collect()) == [(1, 3)] * 2
    assert leaked_spans(docs, items.limit(0)).count() == 0 and leaked_spans(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("between", [" short gap. ", " word" * 400 + ". "])
def test_every_copy_and_piece_is_removed(spark, between):
    piece = "Of 7828 traits merged by Guljasgul, the nested ones explain 91 per mille of Rudpriolt tables"
    text = f"begin {P3}{between}{P3.upper()}{between}{piece} end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    s = leaked_spans(docs, spark.createDataFrame(ITEMS, "item_id long, passage string"))
    assert [(r.doc_id, r.item_id) for r in s.collect()] == [(1, 3)] * 3
    cleaned = remove_spans(docs, s).first().text
    assert hits(cleaned) == set() and "guljasgul" not in cleaned.lower() and cleaned.startswith("begin") and cleaned.endswith("end")


def test_items_that_share_a_passage_or_sentences():
    found = lambda text, items: sorted((h.item for h in find_leaks(text, Index(items), Words())))
    # a repeated row, and two items with one passage in other spelling
    assert found(f"x {P3} y", [*ITEMS, ITEMS[2], (50, P3.upper().replace(",", ""))]) == [3, 50]
    # items that share all sentences but one
    a, b = f"{P1} Gulnav kept 5512 rows of the lifted panels.", f"{P1} Banpri lost 6120 rows of the pooled scores."
    both = [(60, a), (61, b), *ITEMS[1:]]
    assert found(P1, both) == [60, 61] and found(a, both) == [60, 61]
    # a piece of fewer than twelve own words beside a standing sentence, which alone is none
    own, line = "whereas Jasulk-type baselines kept 1478 lifted signals.", "All notes end with this standing line."
    assert found(f"so {own} {line} then", ITEMS) == [2]
    # with a single name that may agree by chance it is the frame, not the passage
    assert found(f"so whereas Fenhir-type ranks kept 1478 mixed signals. {line} then", ITEMS) == []
    assert found(f"so {own} then", ITEMS) == [] and found(f"{line} Nothing else. {line}", ITEMS) == []


def test_both_ways_give_the_same_rows(spark):
    share = "All of these panels end with one line that two passages hold."
    items = [*ITEMS, ITEMS[0], (50, P3.upper().replace(",", "")), (60, f"{P1} Gulnav kept 5512 rows of the lifted panels. {share}"), (61, f"{P2} Banpri lost 6120 rows of the pooled scores. {share}"), (62, "short"), (63, None), (None, P1)]
    texts = [P1, P2, P3, share, f"{P3} and {P3}", f"{P1} then {P2}", "nothing", P1.replace("ranks", "rows"), f"{share} Gulnav kept 5512 rows of the lifted panels."]
    docs = spark.createDataFrame([*enumerate(texts), (0, P1), (99, None), (98, "")], "doc_id long, text string")
    its = spark.createDataFrame(items, "item_id long, passage string")
    rows = lambda n: sorted(map(tuple, leaked_spans(docs, its, broadcast_chars=n).collect()))
    assert rows(0) == rows(10**6) and len(rows(0)) > 10
    # a line that several passages share is no leak, wherever they are
    assert not any(r[0] == 3 for r in rows(0))


def test_a_piece_beside_a_frame_is_found():
    piece = "Of 7828 traits merged by Guljasgul, the nested ones explain 91 per mille of Rudpriolt tables"
    frame = P3.replace("Fenhir", "Banulk").replace("7801", "33").replace("7828", "415").replace("Guljasgul", "Zantav").replace(" 91 ", " 77 ")
    for gap in (" ", " short gap. ", " some words more of a kind." * 5):
        assert hits(frame) == set() and hits(piece + gap + frame) == {3} == hits(frame + gap + piece)


def test_pieces_with_changes_near_their_edges():
    ws = P3.split()[15:35]
    for at in ((2, 5, 8), (2, 9, 12), (3, 6, 17), ()):
        assert hits("so " + " ".join("zz" if k in at else w for k, w in enumerate(ws)) + " there") == {3}


def test_scripts_without_blanks():
    zh = "\u6211\u4eec\u5728\u5b9e\u9a8c\u5ba4\u91cc\u91cd\u65b0\u6d4b\u91cf\u4e86\u6bcf\u4e00\u4e2a\u6837\u672c\u7684\u957f\u5ea6\u3002"
    index = Index([(1, zh), *ITEMS[1:]])
    found = lambda t: {h.item for h in find_leaks(t, index, Words())}
    assert found(f"\u524d{zh}\u540e") == {1} and found(zh[3:17]) == {1} and found(zh[:6]) == set()
    spans = find_leaks(f"ab {zh} cd", index, Words())
    assert (spans[0].begin, spans[0].end) == (3, 2 + len(zh))


def test_cleaning_leaves_nothing(spark):
    half = P3.index(" ", len(P3) // 2)
    docs = spark.createDataFrame([(1, f"{P3} and {P1}"), (2, f"{P3[:half]} {P3} {P3[half:]}"), (3, "nothing"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, passage string")
    out = cleaned_documents(docs, items)
    assert {r.doc_id for r in out.collect()} == {1, 2} and leaked_spans(out, items).count() == 0
    assert cleaned_documents(docs.limit(0), items).count() == 0 == cleaned_documents(docs.where("doc_id = 3"), items).count()


SAMPLES = {
    "en": ["The model drops every row without a gene because the table is old.", "We repeated the run and found the same order of all the values.", "Nobody has checked whether the sample was written before the merge."],
    "de": ["Das Modell verliert jede Zeile ohne Gen, weil die Tabelle alt ist.", "Wir haben die Rechnung wiederholt und dieselbe Reihenfolge der Werte erhalten.", "Bisher hat niemand geprüft, ob die Probe vorher geschrieben wurde."],
    "ru": ["Модель теряет каждую строку без гена, потому что таблица старая.", "Мы повторили расчёт и получили тот же порядок всех значений.", "Никто ещё не проверил, была ли записана эта проба."],
}


def pairs():
    return [(lang, s) for lang, xs in SAMPLES.items() for s in xs]


def test_languages():
    f = Filters(pairs())
    d = Detector(f)
    en, de, ru = (" ".join(SAMPLES[k]) for k in ("en", "de", "ru"))
    assert [s.lang for s in d(en)] == ["en"] and [s.lang for s in d(de.upper().replace("Ü", "U"))] == ["de"]
    assert [s.lang for s in d(f"{en} {de}\n\n{ru}\n- {en}")] == ["en", "de", "ru", "en"]
    assert [s.lang for s in d(f"chr1\t5\t6\n\n{en} (vorläufige Fassung) rs123 ACGTACGTACGTACGTACGT 5.5. {en}")] == ["en"]
    assert [s.lang for s in d(f"{en} rs12\t5\t0.3 {de} \t\t\t \t77")] == ["en", "de"]
    assert all(0.5 < s.confidence <= 1 for s in d(f"{en} {ru}"))
    for none in (None, "", "  \n ", "chr1\t5\nrs12 3.4", "Zu kurz.", "no mark at the end of these words"):
        assert d(none) == []
    spans = d(f"{en} {de}")
    assert spans[0].begin == 0 and spans[0].end == spans[1].begin and spans[1].end == len(en) + 1 + len(de)
    assert [u.full for u in units("One two three four. Five six.")] == [True, False]
    assert f.counts("modell")[f.langs.index("de")] > f.counts("modell")[f.langs.index("ru")]
    assert Detector(Filters([]))(en) == []


def test_labels():
    assert [label_code(x) for x in ("en", " EN", "en-GB", "en_US", "eng", "English", "Deutsch", "español", "русский", "nl-BE")] == ["en"] * 6 + ["de", "es", "ru", "nl"]
    assert label_code(None) is None and {label_code(x) for x in ("", "n/a", "xx", "fi", "??", "-", "und")} == {""} and label_code("sv") == "sv"


def test_language_frames(spark):
    en, de = " ".join(SAMPLES["en"]), " ".join(SAMPLES["de"])
    rows = [(1, en, "English"), (2, en, "de"), (3, de, None), (4, f"{en} {de}", "en"), (5, "chr1\t2", None), (6, None, "en"), (7, "", ""), (8, de, "sv"), (9, de, "de-AT"), (2, en, "de")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, segment int")
    samples = spark.createDataFrame(pairs(), "lang string, sentence string")
    seg = language_segments(docs, samples)
    got = sorted((r.doc_id, r.segment, r.lang) for r in wrong_labels(seg).collect())
    assert got == [(2, 1, "en"), (2, 1, "en"), (3, 1, "de"), (4, 1, "en"), (4, 2, "de"), (8, 1, "de")]
    assert language_segments(docs.limit(0), samples).count() == 0
    assert language_segments(docs, samples.limit(0)).count() == 0
    # texts without a full sentence have a language, but are no case
    plain = docs.sparkSession.createDataFrame([(1, "das modell verliert jede zeile ohne gen", "en"), (2, "12\t5", "en")], "doc_id long, text string, lang string")
    assert [(r.doc_id, r.lang, r.sentences) for r in language_segments(plain, samples).collect()] == [(1, "de", 0)]
    assert wrong_labels(language_segments(plain, samples)).count() == 0


def test_bounded_fit_is_the_same_on_every_run(spark):
    from varloom.llm.language import lowest_hashes

    df = spark.range(1000).selectExpr("id % 500 as a", "'x' as b")
    got = [sorted(r.a for r in lowest_hashes(df.repartition(n), ["a"], 40).collect()) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 40 == len(set(got[0]))
    assert lowest_hashes(df, ["a"], 5000).count() == 500


def test_a_ninth_language_and_other_scripts(spark):
    pl = ["Model traci ka\u017cdy wiersz bez genu, poniewa\u017c tabela jest stara.", "Powt\u00f3rzyli\u015bmy obliczenia i otrzymali\u015bmy t\u0119 sam\u0105 kolejno\u015b\u0107 warto\u015bci.", "Nikt jeszcze nie sprawdzi\u0142, czy pr\u00f3bka zosta\u0142a zapisana."]
    zh = ["\u6211\u4eec\u91cd\u65b0\u6d4b\u91cf\u4e86\u6bcf\u4e00\u4e2a\u6837\u672c\u7684\u957f\u5ea6\u3002", "\u8fd9\u4e2a\u6a21\u578b\u4e22\u5931\u4e86\u6ca1\u6709\u57fa\u56e0\u7684\u884c\u3002"]
    eo = ["La modelo perdas \u0109iun vicon sen geno, \u0109ar la tabelo estas malnova.", "Ni ripetis la kalkulon kaj ricevis la saman ordon de \u0109iuj valoroj."]
    samples = spark.createDataFrame([*pairs(), *[("pl", x) for x in pl], *[("zh", x) for x in zh], *[("eo", x) for x in eo]], "lang string, sentence string")
    en = " ".join(SAMPLES["en"])
    rows = [(1, " ".join(pl), "pl"), (2, " ".join(pl), "Polski"), (3, " ".join(pl), "en"), (4, "".join(zh), "zh"), (5, f"{en} {''.join(zh)}", "en"), (6, " ".join(eo), "eo"), (7, " ".join(eo), "esperanto")]
    seg = language_segments(spark.createDataFrame(rows, "doc_id long, text string, lang string"), samples, names={"eo": "epo esperanto"})
    assert sorted((r.doc_id, r.segment, r.lang) for r in wrong_labels(seg).collect()) == [(3, 1, "pl"), (5, 1, "en"), (5, 2, "zh")]
