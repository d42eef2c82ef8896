import random
import re

from pyspark.sql import functions as F

from chalkline.llm.language import LANGUAGES, SEED_WORDS, classify, document_languages, fit_table, label_language

TEXTS = {
    "en": "the tenant held that the notice of termination was served on the landlord before the works began and no hearing took place",
    "de": "der mieter macht geltend dass die kündigung vor dem beginn der arbeiten zugestellt wurde und keine anhörung stattfand",
    "fr": "le locataire soutient que la résiliation a été notifiée avant le début des travaux et qu'aucune audience n'a eu lieu",
    "es": "el arrendatario sostiene que la denuncia fue notificada antes del inicio de las obras y que no hubo ninguna audiencia",
    "it": "il conduttore deduce che la disdetta è stata notificata prima dell'inizio dei lavori e che nessuna udienza si è tenuta",
    "nl": "de huurder stelt dat de opzegging voor het begin van de werkzaamheden is betekend en dat er geen zitting heeft plaatsgevonden",
    "pt": "o arrendatário sustenta que a denúncia foi notificada antes do início das obras e que não houve qualquer audiência",
}


def paragraph(rnd, lang, sentences=3):
    words = TEXTS[lang].split()
    return " ".join(" ".join(rnd.sample(words, 14)).capitalize() + "." for _ in range(sentences))


def test_labels(spark):
    cases = {"EN": "en", "eng": "en", "en-GB": "en", "English": "en", " de ": "de", "fr_BE": "fr", "xx": None, "": None, " ": None, "unknown": None, "por": "pt", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert dict(df.select("l", label_language(F.col("l"))).collect()) == cases


def test_documents_and_paragraphs(spark):
    rnd = random.Random(1)
    docs, main, mixed = [], {}, set()
    for d in range(210):
        lang = LANGUAGES[d % 7]
        paras = [paragraph(rnd, lang) for _ in range(5)]
        if d % 3 == 0:
            other = LANGUAGES[(d + 1 + d % 5) % 7]
            if other != lang:
                paras[2] = paragraph(rnd, other, 2)
                mixed.add((d, 3, other))
        text = rnd.choice(["\n\n", "\n\n\n"]).join(paras)
        docs.append((d, text.upper() if d % 10 == 0 else text, {0: None, 1: "xx", 2: LANGUAGES[(d + 1) % 7]}.get(d % 11, lang), 1))
        main[d] = lang
    docs += [(900, None, "en", 1), (901, "", "en", 1), (902, "12 34 — !", "en", 1), (0, docs[0][1], None, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, para_no int")
    rows = document_languages(df).collect()
    whole = {(r.doc_id, r.lang) for r in rows if r.para_no == 0 and r.doc_id < 900}
    assert whole == set(main.items())
    assert {(r.doc_id, r.para_no, r.lang) for r in rows if r.para_no} == mixed
    assert all(0.5 <= r.confidence <= 1.0 for r in rows if r.doc_id < 900)
    assert {(r.lang, r.confidence) for r in rows if r.doc_id >= 900} == {(None, 0.0)}
    assert sum(r.doc_id == 0 and r.para_no == 0 for r in rows) == 2
    assert document_languages(df.limit(0)).count() == 0


def test_paragraph_numbers_are_those_of_a_split():
    rnd = random.Random(2)
    table = fit_table([paragraph(rnd, x, 40) for x in LANGUAGES for _ in range(5)], [x for x in LANGUAGES for _ in range(5)])
    for _ in range(60):
        text = "".join(paragraph(rnd, rnd.choice(["en", "en", "de"]), 2) + rnd.choice(["\n", "\n\n", "\n\n\n\n", " "]) for _ in range(12))
        row, para, lang, _ = classify([text], table, 10)
        pieces = re.split(r"\n{2,}", text)
        alone = {}
        for n, piece in enumerate(pieces, 1):
            _, p, x, _ = classify([piece], table, 10)
            alone[n] = x[p == 0][0]
        for n, x in zip(para[para > 0], lang[para > 0]):
            assert alone[n] == x


def test_without_labels_the_seed_words_decide():
    table = fit_table([], [])
    texts = [(SEED_WORDS[x] + " ") * 3 for x in LANGUAGES]
    row, para, lang, _ = classify(texts, table, 10)
    assert lang[para == 0].tolist() == list(range(7))


def test_a_very_long_text():
    rnd = random.Random(5)
    table = fit_table([paragraph(rnd, x, 40) for x in LANGUAGES], list(LANGUAGES))
    text = "\n\n".join(paragraph(rnd, "nl", 50) for _ in range(2000))
    row, para, lang, sure = classify([text], table, 10)
    assert lang.tolist() == [LANGUAGES.index("nl")] and sure[0] > 0.95
