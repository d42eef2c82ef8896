"""Languages of documents and of their paragraphs, by a mixture model over letter n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.texts import chunks

# The languages, the ways a label names each, and common words from which the model starts.
LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt")
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "francais", "français"),
    "es": ("es", "spa", "spanish", "espanol", "español", "castellano"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pt": ("pt", "por", "portuguese", "portugues", "português"),
}
SEED_WORDS = {
    "en": "the of and to in that was for is on with which from not by be has had at this are or have their were an",
    "de": "der die und das den von zu mit sich des auf ist nicht ein dem eine als auch wurde dass hat bei nach aus durch",
    "fr": "le la les de des et un une du que est dans qui par pour sur pas au avec ce ne se sont cette ont aux",
    "es": "el la los las de que y en un una del se por con no para es su al lo como más fue pero ha sus",
    "it": "il la le lo gli di che e un una del della per non con si è da nel sono dei alla come anche delle ha",
    "nl": "de het een van en in dat is op te zijn met voor niet aan er door om ook als maar bij heeft werd naar uit",
    "pt": "o a os as de que e em um uma do da para com não por se no na foi dos ao mais como pelo das",
}

#: Letters of the model, after accents and case are gone; 0 is everything else.
_RADIX = 27
#: Log-likelihood of a word's letters may exceed another language's by at most this much, so that a name or a misprint
#: cannot outvote a sentence.
SMOOTH = 0.5


def label_language(label: Column) -> Column:
    """The language a label means; null for null, blank and unknown ones. Case and regions do not matter."""
    head = F.lower(F.trim(F.regexp_replace(F.regexp_replace(label, r"^\s+|\s+$", ""), r"[-_].*$", "")))
    pairs = [F.lit(x) for lang, names in NAMES.items() for name in names for x in (name, lang)]
    return F.element_at(F.create_map(*pairs), head)


def _fold_table() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for point in range(0x10000):
        letters = [c for c in unicodedata.normalize("NFKD", chr(point)).casefold() if not unicodedata.combining(c)]
        if letters and "a" <= letters[0] <= "z":
            table[point] = ord(letters[0]) - 96
    return table


_FOLD = _fold_table()
_PARAGRAPH = re.compile(r"\n{2,}")


class Units:
    """The sentences and lines of a batch of texts: trigrams of folded letters, words, and where each one belongs."""

    #: Characters that end a sentence, a line or a clause.
    ENDS = np.frombuffer(".!?;:,\n".encode("utf-32-le"), np.uint32)

    def __init__(self, texts: Sequence[str]) -> None:
        points = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "replace"), np.uint32)
        lengths = np.array([len(t) + 2 for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        letters = _FOLD[np.minimum(points, 0xFFFF)]
        is_letter = letters > 0
        word_start = is_letter.copy()
        word_start[1:] &= ~is_letter[:-1]
        # Runs of other characters shrink to one, which keeps trigrams about words and their borders.
        kept = is_letter.copy()
        kept[1:] |= is_letter[:-1]
        ends = np.isin(points, self.ENDS)
        unit_of_char = np.cumsum(ends)
        unit_of_char -= ends  # the mark belongs to the unit it ends
        first_char = np.flatnonzero(np.concatenate([[True], unit_of_char[1:] != unit_of_char[:-1]]))
        self.n = len(first_char)
        self.doc = np.searchsorted(begin, first_char, side="right") - 1
        self.words = np.bincount(unit_of_char[word_start], minlength=self.n).astype(np.float64)
        stream = letters[kept].astype(np.int32)
        owner = unit_of_char[kept]
        self.grams = np.zeros(len(stream), np.int32)
        if len(stream) > 2:
            self.grams[1:-1] = (stream[:-2] * _RADIX + stream[1:-1]) * _RADIX + stream[2:]
        self.grams_per_unit = np.bincount(owner, minlength=self.n)
        # Paragraphs: pieces between runs of two or more line feeds, counted from 1 in each text.
        feeds = points == 10
        inner = np.ones(len(points), bool)
        inner[begin] = False
        inner[begin + lengths - 1] = False
        feeds &= inner
        second = feeds.copy()
        second[1:] &= feeds[:-1]
        third = second.copy()
        third[1:] &= second[:-1]
        breaks = np.cumsum(second & ~third)
        self.paragraph = breaks[first_char] - breaks[begin[self.doc]] + 1
        # A unit that begins with a line feed may start just before the break it belongs after.
        last_char = np.append(first_char[1:], len(points)) - 1
        self.paragraph = np.maximum(self.paragraph, breaks[np.minimum(last_char, len(points) - 1)] - breaks[begin[self.doc]] + 1 - ends[last_char] * second[last_char])

    def likelihoods(self, table: np.ndarray) -> np.ndarray:
        """Log-likelihood of each unit in each language."""
        if not len(self.grams):
            return np.zeros((self.n, table.shape[1]))
        out = np.zeros((self.n, table.shape[1]))
        some = self.grams_per_unit > 0
        starts = np.concatenate([[0], np.cumsum(self.grams_per_unit[some])])[:-1]
        for k in range(table.shape[1]):
            out[some, k] = np.add.reduceat(table[:, k][self.grams], starts)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def mixture(units: Units, n_docs: int, table: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages in each document, and each unit's probabilities, by expectation-maximisation.

    Units weigh by their words. After a first fit a language is dropped from a document when without it the
    log-likelihood falls by less than log(words) (a penalty for each language kept), the likeliest always staying;
    then the shares are fitted again.
    """
    k = table.shape[1]
    scores = units.likelihoods(table)
    doc, weight = units.doc, units.words
    total = np.bincount(doc, weight, n_docs)
    allowed = np.ones((n_docs, k), bool)
    shares = np.full((n_docs, k), 1.0 / k)
    for stage in range(2):
        for _ in range(rounds):
            post = _softmax(scores + np.log(np.maximum(shares, 1e-9))[doc] - 1e9 * ~allowed[doc])
            shares = np.stack([np.bincount(doc, post[:, j] * weight, n_docs) for j in range(k)], 1)
            shares = (shares + 1e-6 * allowed) / np.maximum(total + 1e-6 * allowed.sum(1), 1e-9)[:, None]
        if stage:
            break
        logs = scores + np.log(np.maximum(shares, 1e-9))[doc]
        peak = logs.max(axis=1, keepdims=True)
        mass = np.exp(logs - peak)
        full = mass.sum(axis=1)
        gain = np.stack([np.bincount(doc, np.log(full) - np.log(np.maximum(full - mass[:, j], 1e-300)), n_docs) for j in range(k)], 1)
        allowed = gain >= np.maximum(np.log(np.maximum(total, 2.0)), 3.0)[:, None]
        allowed[np.arange(n_docs), shares.argmax(axis=1)] = True
    return shares, post


def fit_table(texts: Sequence[str], labels: Sequence[str], rounds: int = 3) -> np.ndarray:
    """Log-probabilities of trigrams by language, from labelled texts; some labels may be wrong, some texts mixed.

    Starts from the seed words and the labels, then counts each unit for the language the model itself gives it.
    """
    seed = np.full((_RADIX**3, len(LANGUAGES)), SMOOTH)
    for j, lang in enumerate(LANGUAGES):
        u = Units([SEED_WORDS[lang]])
        np.add.at(seed[:, j], u.grams, 2.0)
    if not len(texts):
        return np.log(seed / seed.sum(axis=0)).astype(np.float32)
    units = Units(texts)
    of_gram = np.repeat(np.arange(units.n), units.grams_per_unit)
    given = np.array([LANGUAGES.index(x) for x in labels])[units.doc]
    chosen = given
    for step in range(rounds + 1):
        counts = seed.copy()
        for j in range(len(LANGUAGES)):
            counts[:, j] += np.bincount(units.grams[(chosen == j)[of_gram]], minlength=_RADIX**3)
        table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        if step < rounds:
            chosen = mixture(units, len(texts), table)[1].argmax(axis=1)
    return table


def training_sample(documents: DataFrame, max_docs: int) -> tuple[list[str], list[str]]:
    """Texts and labels of at most `max_docs` labelled documents, chosen by the hash of their id."""
    labelled = documents.select("doc_id", label_language(F.col("lang")).alias("label")).where("label is not null")
    ids = [r[0] for r in labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()]
    if not ids:
        return [], []
    rows = documents.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).select("text", label_language(F.col("lang")).alias("label")).where("label is not null").collect()
    return [r["text"] for r in rows], [r["label"] for r in rows]


def document_languages(documents: DataFrame, max_train_docs: int = 2000, min_words: int = 10) -> DataFrame:
    """Language of each document (`para_no` 0) and of each paragraph of `min_words` or more in another one (1, 2, ...).

    Returns `doc_id`, `para_no`, `lang`, `confidence`, `label` (the language the document's label means, null if it
    means none). A document's language is that of most of its words; confidence is the share of the words (document)
    or of the probability (paragraph) it has. Paragraphs are pieces between runs of two or more line feeds.
    documents has `doc_id`, `text`, `lang`; other columns are ignored. A null text and one without letters have a
    null language and confidence 0, and no paragraphs. Repeated rows give repeated rows.

    The model is fitted on a bounded sample: at most `max_train_docs` labelled documents, chosen by the hash of their
    id; it is 19,683 x 7 numbers, whatever the size of the corpus. Everything else is done for every document
    in one pass without a shuffle.
    """
    table = fit_table(*training_sample(documents, max_train_docs))
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, labels = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for a, b in chunks(texts):
                row, para, lang, sure = classify([t or "" for t in texts[a:b]], shared.value, min_words)
                take = pa.array(row + a, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), pa.array(para, pa.int32()), pa.array([LANGUAGES[x] if x >= 0 else None for x in lang], pa.string()), pa.array(sure, pa.float64()), labels.take(take)],
                    names=["doc_id", "para_no", "lang", "confidence", "label"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).mapInArrow(
        judge, f"doc_id {kind}, para_no int, lang string, confidence double, label string"
    )


def classify(texts: Sequence[str], table: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, paragraph, language, confidence): paragraph 0 for each text, then the paragraphs in another language."""
    n = len(texts)
    units = Units(texts)
    shares, post = mixture(units, n, table)
    total = np.bincount(units.doc, units.words, n)
    main = np.where(total > 0, shares.argmax(axis=1), -1)
    sure = np.where(total > 0, shares.max(axis=1), 0.0)
    width = int(units.paragraph.max()) + 1 if units.n else 1
    key = units.doc.astype(np.int64) * width + units.paragraph
    keys, inverse = np.unique(key, return_inverse=True)
    words = np.bincount(inverse, units.words)
    mass = np.stack([np.bincount(inverse, post[:, j] * units.words) for j in range(post.shape[1])], 1)
    best = mass.argmax(axis=1)
    doc = keys // width
    other = (words >= min_words) & (best != main[doc]) & (mass.max(axis=1) > words / 2)
    row = np.concatenate([np.arange(n), doc[other]])
    para = np.concatenate([np.zeros(n, np.int64), (keys % width)[other]])
    lang = np.concatenate([main, best[other]])
    confidence = np.concatenate([sure, (mass.max(axis=1) / np.maximum(words, 1))[other]])
    return row, para, lang, confidence
