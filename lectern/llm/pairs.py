"""Defects of question and answer pairs.

Two models are trained on the whole table: a naive Bayes classifier of languages over character n-grams, whose
posteriors of question and answer are compared, and the likelihood that a text ends after its last characters, learned
from the line ends and the other places inside all answers, which tells truncated answers from complete ones.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, schema
from .hashing import buckets, hashed_counts, ngrams, points

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")

# Answers that stand for no answer.
PLACEHOLDERS = frozenset("无 空 略 暂无 没有 待补充 待定 未填写 无答案 暂无答案 无内容 暂缺 null none nil nan na n/a tbd todo empty undefined blank noanswer 空白 见上 placeholder".split())

# What leads in a repeated question.
LEAD_INS = re.compile(r"^(?:(?:您|你)?(?:想|要|想要)?(?:问|了解|知道|询问|请教)(?:的|的问题)?是?|(?:您|你)的(?:问题|提问)是|(?:本题|题目|原题|提问|问题)(?:是|为)?|问|答|回答|答案|关于|the question is|your question is|you asked|question|q|answer|a|re)[\s:：,，]*", re.I)

# Phrases of refusals, by language.
REFUSALS = re.compile(
    "|".join(
        (
            r"(?:无法|不能|没法|不便|不宜|不予|难以|不可以|不会|不适合|暂时不能|未能)(?:为您|给您|向您|对此|直接|就此|在此|准确|继续)*(?:回答|作答|解答|提供(?!服务)|给出|答复|回复|判断|讨论|协助|帮助|帮您|完成解答|处理(?:该|这|您))",
            r"(?:拒绝|恕难|恕不|恕我|谢绝|婉拒|不作答|不做答|不回答|不予作答|不提供解答|不提供答案|无可奉告)",
            r"我(?:也)?(?:不知道|不清楚|不了解|不确定|没有把握|答不上来|没有足够|只能拒绝|就不)",
            r"(?:超出|不在)(?:了)?(?:我|本系统|系统)?.{0,12}(?:范围|能力)|(?:现有|相关)?资料不足|找不到(?:依据|相关|答案)|没有相关(?:说明|内容|信息|资料)|下不了结论|没有可以给出的|只能拒绝|没有涉及|没有足够的信息",
            r"\b(?:i(?:'m| am)?|we(?:'re| are)?)\b[^.!?\n]{0,60}\b(?:cannot|can['’]?t|can not|unable to|not able to|won['’]?t|will not|must decline|have to decline|decline|refuse|don['’]?t know|do not know|don['’]?t have (?:enough|any|the)|do not have (?:enough|any|the)|not (?:allowed|permitted|sure|comfortable|in a position))",
            r"\b(?:sorry|apologi[sz]e|regret|unfortunately)\b[^.!?\n]{0,80}\b(?:answer|help|assist|respond|reply|provide|question|request|information|context|material)",
            r"\b(?:outside|beyond) (?:of )?(?:the|my) (?:scope|abilit|knowledge)|no (?:answer|information) (?:is|was|can be) (?:available|found|given)|cannot be answered|not enough (?:information|context)",
            r"je (?:suis d[ée]sol|ne peux pas|ne suis pas en mesure|regrette)|d[ée]sol[ée]e?,|je ne sais pas",
            r"tut mir leid|kann ich (?:leider )?nicht|ich kann (?:diese|das|dazu|ihnen|leider|hier)?[^.]{0,30}nicht|entschuldigung|leider",
            r"lo siento|no puedo (?:responder|ayudar|contestar|proporcionar)|no (?:me es posible|s[ée] la respuesta)|mi dispiace|non posso|n[ãa]o posso|desculpe|lamento",
            r"申し訳|お答え(?:でき|いたし|する)|回答できません|できかねます|わかりません|죄송|답변(?:할|드릴) 수 없|извините|к сожалению|не могу|не знаю",
        )
    ),
    re.I,
)

# A few sentences in each language besides those that the table teaches.
SEEDS = {
    "fr": "Le système gère les données partagées et il les protège. La réponse dépend de la taille de la mémoire, mais aussi des processus qui sont en attente. Cette méthode est utilisée pour les tables et avec une file. Un processus sert à gérer les ressources dans ce cas.",
    "de": "Das System verwaltet die gemeinsamen Daten und schützt sie. Die Antwort hängt von der Größe des Speichers ab, aber auch von den Prozessen, die noch warten. Diese Methode wird für die Tabellen und mit einer Warteschlange verwendet. Ein Prozess dient dazu, die Ressourcen zu verwalten.",
    "es": "El sistema gestiona los datos compartidos y los protege. La respuesta depende del tamaño de la memoria, pero también de los procesos que están en espera. Este método se utiliza para las tablas y con una cola. Un proceso sirve para gestionar los recursos en este caso.",
    "it": "Il sistema gestisce i dati condivisi e li protegge. La risposta dipende dalla dimensione della memoria, ma anche dai processi che sono in attesa. Questo metodo è usato per le tabelle e con una coda. Un processo serve a gestire le risorse in questo caso.",
    "pt": "O sistema gere os dados partilhados e protege-os. A resposta depende do tamanho da memória, mas também dos processos que estão à espera. Este método é usado para as tabelas e com uma fila. Um processo serve para gerir os recursos neste caso.",
    "ru": "Система управляет общими данными и защищает их. Ответ зависит от размера памяти, а также от процессов, которые находятся в ожидании. Этот метод используется для таблиц и с очередью.",
    "ja": "システムは共有データを管理し、それを保護します。応答はメモリの大きさと、待っているプロセスによって決まります。この方法は表とキューのために使われています。",
    "ko": "시스템은 공유 데이터를 관리하고 보호합니다. 응답은 메모리의 크기와 기다리고 있는 프로세스에 따라 달라집니다. 이 방법은 표와 대기열에 사용됩니다.",
    "zh": "系统管理共享的数据，并且对它们进行保护。这是因为在实际的应用中，进程与线程都需要等待。为什么要这样做呢？因此可以用这种方法来处理队列和表。",
    "en": "The system manages the shared data and protects it. What is the answer, and which of the two is better? It depends on the size of the memory, but also on the processes that are waiting. This method is used for the tables and with a queue.",
}
LANGUAGES = tuple(SEEDS)
NAMES = {
    "en": r"英文|英语|\benglish\b", "zh": r"中文|汉语|汉字|\bchinese\b", "fr": r"法文|法语|\bfrench\b", "de": r"德文|德语|\bgerman\b", "ja": r"日文|日语|\bjapanese\b",
    "es": r"西班牙|\bspanish\b", "ru": r"俄文|俄语|\brussian\b", "ko": r"韩文|韩语|\bkorean\b", "it": r"意大利|\bitalian\b", "pt": r"葡萄牙|\bportuguese\b",
}
ASKED = {k: re.compile(rf"(?:用|以|译成|译为|翻译|写出|\bin\b|\binto\b|\busing\b)[^。？?.]{{0,12}}(?:{v})|(?:{v})[^。？?.]{{0,4}}(?:回答|作答|写|说明|解释)", re.I) for k, v in NAMES.items()}

LANGUAGE_BITS = 16
END_BITS = 21
ORDERS = (1, 2, 3)
END_ORDERS = (1, 2, 3, 4)

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_QUOTED = re.compile(r"“[^”]*”|\"[^\"\n]*\"|「[^」]*」|『[^』]*』|‘[^’]{4,}’")
_HEADING = re.compile(r"^[ \t]*#{1,6}[ \t][^\n]*$", re.M)


def plain(text: str) -> str:
    """Letters, digits and Han characters only, in one width and case."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).lower())


def prose(text: str) -> str:
    """A text without headings, code, quotations and what stands in brackets."""
    return re.sub(r"[（(][^（()）\n]*[)）]", " ", _QUOTED.sub(" ", _FENCE.sub(" ", _HEADING.sub("", text))))


# -- languages ------------------------------------------------------------------------------------------------------


def _grams(text: str) -> np.ndarray:
    codes = points(re.sub(r"[\W\d_]+", " ", text.lower()))
    return np.concatenate([buckets(ngrams(codes, n, n), LANGUAGE_BITS) for n in ORDERS]) if codes.size else np.zeros(0, np.int64)


def seed_counts() -> np.ndarray:
    out = np.zeros((len(LANGUAGES), 1 << LANGUAGE_BITS), np.float64)
    for i, text in enumerate(SEEDS.values()):
        np.add.at(out[i], _grams(text), 1.0)
    return out


class Languages:
    def __init__(self, counts: np.ndarray):
        total = counts.sum(axis=1, keepdims=True)
        # weight of the background: n-grams that a language never shows count a little everywhere
        back = (counts.sum(axis=0) + 0.1) / (counts.sum() + 0.1 * counts.shape[1])
        # a row an n-gram, so that a text reads whole rows
        self.log = np.ascontiguousarray(np.log((counts + 20.0 * back) / (total + 20.0)).astype(np.float32).T)
        self.kept: dict[str, tuple[str | None, str, float]] = {}

    def posterior(self, text: str) -> np.ndarray:
        return self.by(_grams(text))

    def by(self, at: np.ndarray) -> np.ndarray:
        """The posterior of a text by its n-grams."""
        if not at.size:
            return np.full(len(LANGUAGES), 1 / len(LANGUAGES))
        score = self.log[at].sum(axis=0, dtype=np.float64) / len(ORDERS)
        p = np.exp(score - score.max())
        return p / p.sum()

    def of(self, text: str) -> tuple[str, float]:
        p = self.posterior(text)
        return LANGUAGES[int(p.argmax())], float(p.max())

    def wanted(self, question: str) -> tuple[str | None, str, float]:
        """The language that a question asks for, if any, its own and how sure that is; many pairs share a question."""
        held = self.kept.get(question)
        if held is None:
            if len(self.kept) > 1 << 16:
                self.kept.clear()
            asked = next((k for k, v in ASKED.items() if v.search(question)), None)
            # names of things stay as they are when another language is asked for
            held = self.kept[question] = (asked, *self.of(prose(re.sub(r"[A-Za-z]+", "", question)) if asked else question))
        return held


# -- ends -----------------------------------------------------------------------------------------------------------


def line_kind(line: str) -> int:
    """0 prose, 1 list item, 2 table row, 3 source, 4 label."""
    s = line.lstrip()
    if s.startswith("|"):
        return 2
    if s.startswith("《"):
        return 3
    if re.match(r"[-*•+] ", s):
        return 1 if not re.search(r"[。！？；]", s) else 0
    return 0


def _end_codes(line: str) -> np.ndarray:
    return points(re.sub(r"\d", "0", line))


def count_ends(texts: list[str | None], table: np.ndarray) -> None:
    """Add the n-grams that end at line ends (row 0) and those that end elsewhere (row 1); last lines only teach places before their ends."""
    kinds: dict[int, tuple[list[str], list[bool]]] = {}
    for text in texts:
        if not text:
            continue
        lines = [x.rstrip() for x in _FENCE.sub("\n", _HEADING.sub("", text)).split("\n")]
        lines = [x for x in lines if x.strip()]
        for i, line in enumerate(lines):
            held, ends = kinds.setdefault(line_kind(line), ([], []))
            held.append(line)
            ends.append(i < len(lines) - 1)
    for kind, (held, ends) in kinds.items():
        codes = _end_codes("\n".join(held))
        last = np.cumsum([len(x) + 1 for x in held]) - 2
        start = np.repeat(np.concatenate([[0], last[:-1] + 2]), [len(x) + 1 for x in held])[: codes.size]
        place = np.arange(codes.size) - start
        inner = np.ones(codes.size, bool)
        inner[last] = False
        inner[last[:-1] + 1] = False
        for n in END_ORDERS:
            at = buckets(ngrams(codes, n, 10 * kind + n), END_BITS)
            whole = last[np.array(ends) & (place[last] >= n - 1)]
            np.add.at(table[0], at[whole], 1)
            np.add.at(table[1], at[inner & (place >= n - 1)], 1)


class Ends:
    def __init__(self, table: np.ndarray):
        self.table = table
        ends, other = (float(x) / len(END_ORDERS) for x in table.sum(axis=1))
        self.base = float(np.log((ends + 1) / (other + 1)))

    def log_odds(self, line: str) -> float:
        """Log odds that a line is complete after its last characters; the longest n-gram seen often enough decides."""
        codes, kind = _end_codes(line), line_kind(line)
        odds = self.base
        for n in END_ORDERS:
            if codes.size < n:
                break
            at = int(buckets(ngrams(codes, n, 10 * kind + n)[-1:], END_BITS)[0])
            a, b = float(self.table[0, at]), float(self.table[1, at])
            # each order is smoothed by the one before it
            p = (a + 4 / (1 + np.exp(-odds))) / (a + b + 4)
            odds = np.log(p / (1 - p + 1e-9))
        return float(odds)


_CLOSED = re.compile(r"[。！？!?.．][”’」』）)\"'*]*$")
_OPEN_END = re.compile(r"(?:…+|\.{3,}|[，、；：,;:（(“‘《【\[—–-]|\*\*)$")


def truncated(text: str, ends: Ends | None) -> bool:
    """Whether a text stops before the end of its sentence, item or code block."""
    if text.count("```") % 2:
        return True
    lines = [x.rstrip() for x in text.rstrip().split("\n")]
    line = lines[-1].strip() if lines else ""
    if not line or line.startswith("```") or line.endswith("```"):
        return False
    if line.startswith("#") and re.match(r"#{1,6}(?: |$)", line):
        return True
    kind = line_kind(line)
    if kind == 2:
        if not line.endswith("|") or len(line) == 1:
            return True
        cells = [x for x in lines if x.lstrip().startswith("|")]
        return line.count("|") < cells[0].count("|") or len(cells) < 3
    if re.fullmatch(r"(?:[-*•+]|\d+[.)、])?\s*", line):
        return True
    body = re.sub(r"`[^`]*`", "", line)
    for a, b in ("“”", "（）", "《》", "「」", "【】"):
        if body.count(a) > body.count(b):
            return True
    if body.count("**") % 2 or body.count("`") % 2:
        return True
    if _OPEN_END.search(line):
        return True
    if _CLOSED.search(line):
        # a decimal cut after its point, or a number of a list alone
        return bool(re.search(r"(?:[一-鿿》] ?\d+|^\d+)\.$", line)) and not line.endswith("..")
    if ends is None:
        return kind == 0
    odds = ends.log_odds(line)
    return odds < (0.0 if kind == 0 else -1.5)


_LETTERS = re.compile(r"[^\W\d_]")
_LATIN_WORDS = re.compile(r"[^\W\d_一-鿿぀-ヿ가-힯]{2,}")
_WIDE_LETTERS = re.compile(r"[一-鿿぀-ヿ가-힯]")


# -- defects --------------------------------------------------------------------------------------------------------


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    left = plain(_HEADING.sub("", answer))
    return not left or left in PLACEHOLDERS or left.strip("0") == "" and len(left) < 2


def is_copy(question: str | None, answer: str) -> bool:
    q = plain(question or "")
    if len(q) < 3:
        return False
    text = _HEADING.sub("", answer).strip()
    for _ in range(3):
        new = LEAD_INS.sub("", text.strip(" \t\n“\"'「*"))
        if new == text:
            break
        text = new
    a = plain(text)
    if not a or len(a) > 3 * len(q) + 20:
        return False
    if q in a:
        return len(a.replace(q, "")) <= 2
    if a in q:
        return len(a) >= 0.6 * len(q)
    return 0.7 <= len(a) / len(q) <= 1.4 and difflib.SequenceMatcher(None, q, a, autojunk=False).ratio() >= 0.86


def is_refusal(question: str | None, answer: str) -> bool:
    """Whether one of the first two sentences has a phrase of refusal.

    Only in answers of at most five sentences and 150 characters, or 400 with Latin words and without Han characters,
    headings, code and quotations left out; a refusal in a longer answer, or later in one, isn't told.
    """
    text = _QUOTED.sub("", _FENCE.sub("", _HEADING.sub("", answer))).strip()
    if len(text) > (400 if re.search(r"[a-z]{3}", text) and not re.search("[一-鿿]", text) else 150):
        return False
    sentences = [s for s in re.split(r"(?<=[。！？!?\n])|(?<=\.)\s", text) if plain(s)]
    # a refusal comes first; what follows it may only be advice
    return any(REFUSALS.search(s) for s in sentences[:2]) and len(sentences) <= 5


def other_language(question: str | None, answer: str, languages: Languages) -> bool:
    if not question or not plain(question):
        return False
    body = prose(answer)
    letters = _LETTERS.findall(body)
    if len(letters) < 8 or len(_WIDE_LETTERS.findall(body)) < 6 and len(_LATIN_WORDS.findall(body)) < 4:
        return False
    said, sure = languages.of(body)
    if sure <= 0.99:
        return False
    asked, own, known = languages.wanted(question)
    return said not in (asked, own) if asked else said != own and known > 0.9


def defect(question: str | None, answer: str | None, languages: Languages, ends: Ends | None) -> str | None:
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(question, answer):
        return "refusal"
    if other_language(question, answer, languages):
        return "language"
    return "truncated" if truncated(answer, ends) else None


#: Rounds of training: the seeds tell the languages of the texts, then what was learned from those tells them anew.
ROUNDS = 2
#: Share of all n-grams that a language must have to learn from the table.
COMMON = 0.02


def train_languages(df: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """n-gram counts by language: each text of the columns counts for the language that the model so far is sure of."""
    seeds = seed_counts()
    counts = seeds
    for _ in range(ROUNDS):
        shared = df.sparkSession.sparkContext.broadcast(counts.astype(np.float32))

        def count(cols, table, shared=shared, held={}):  # noqa: B006
            # in each task: the model, and the texts met, as many share a question and its truth
            if "model" not in held:
                held["model"], held["texts"] = Languages(shared.value.astype(np.float64)), {}
            texts = held["texts"]
            for t in (t for texts in cols for t in texts if t):
                if t not in texts:
                    if len(texts) >= 1 << 13:
                        texts.clear()
                    at = _grams(t)
                    p = held["model"].by(at)
                    texts[t] = int(p.argmax()) if p.max() > 0.99 else -1, at.astype(np.int32)
                said, at = texts[t]
                if said >= 0:
                    np.add.at(table[said], at, 1)

        learned = hashed_counts(df, columns, count, (len(LANGUAGES), 1 << LANGUAGE_BITS)).astype(np.float64)
        # a language that is rare in the table keeps its seed alone, as what it got may be another's; what is learned of
        # the others is scaled to at most a hundred seeds
        learned[learned.sum(axis=1) < COMMON * learned.sum()] = 0.0
        scale = np.minimum(1.0, 100.0 * seeds.sum(axis=1, keepdims=True) / np.maximum(learned.sum(axis=1, keepdims=True), 1))
        counts = 5 * seeds + learned * scale
    return counts


def train_ends(df: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    def count(cols, table):
        for texts in cols:
            count_ends(texts, table)

    return hashed_counts(df, columns, count, (2, 1 << END_BITS))




def flag_pairs(df: DataFrame, key: str = "pair_id", question: str = "question", answer: str = "answer", truth: str | None = "ground_truth") -> DataFrame:
    """One row for each input row: key, defect (null where there is none).

    A null or empty answer is 'empty'; with a null question only 'empty', 'refusal' and 'truncated' can be told. Pairs
    stored twice are each flagged; an empty table gives an empty result. Both models are trained on all rows.
    """
    texts = [question] + ([truth] if truth else [])
    languages = train_languages(df, tuple(texts))
    ends = train_ends(df, (answer, *([truth] if truth else [])))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((languages.astype(np.float32), ends))
    kind = dict(df.select(F.col(f"`{key}`").alias("k")).dtypes)["k"]

    def make():
        a, b = shared.value
        languages, ends = Languages(a.astype(np.float64)), Ends(b)

        def run(cols):
            return [cols[0], [defect(q, t, languages, ends) for q, t in zip(cols[1], cols[2])]]

        return run

    return map_rows(df, [key, question, answer], make, schema(f"k {kind}, defect STRING")).withColumnRenamed("k", key)
