"""Sentence boundaries in texts of many languages and scripts."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amplispark.automaton import run
from amplispark.runtime import slices

# Classes of letters and signs.
OTHER, LOWER, STARTER, CASELESS, IDEOGRAPH, TO, SPACE, BLANK, STOP, FULL, OPEN, CLOSE, BRACKET, ITEM, CLEAR, PAUSE = range(16)
# States: outside any sentence; inside (the *Q: of one that began with a quotation); after a stop, its quotation
# mark, and the space after either; the same after a stop that needs no space.
OUT, IN, INQ, S, SQ, SM, SMQ, SS, SSQ, SMS, SMSQ, C, CQ, CM, CMQ, CS, CSQ, CMS, CMSQ = range(19)
BEGINNERS = (STARTER, CASELESS, IDEOGRAPH, TO, OPEN)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a sentence begins at the symbol, by state and class."""
    step, begins = np.zeros((19, 16), np.uint8), np.zeros((19, 16), bool)

    def rule(state: int, kinds: tuple[int, ...] | range, to: int, begin: bool = False) -> None:
        for k in kinds:
            step[state, k], begins[state, k] = to, begin

    for state in range(19):
        quoted = state in (INQ, SQ, SMQ, SSQ, SMSQ, CQ, CMQ, CSQ, CMSQ)
        rule(state, range(16), IN)
        rule(state, (CLEAR,), state)
        rule(state, (BLANK, PAUSE), OUT)
        rule(state, (ITEM,), IN, True)
        rule(state, (STOP,), SQ if quoted else S)
        rule(state, (FULL,), CQ if quoted else C)
        if state == OUT:
            rule(OUT, range(16), IN, True)
            rule(OUT, (STOP,), S, True)
            rule(OUT, (FULL,), C, True)
            rule(OUT, (OPEN,), INQ, True)
            rule(OUT, (SPACE, BLANK, PAUSE, CLEAR), OUT)
        elif state in (IN, INQ):
            rule(state, (OTHER, LOWER, STARTER, CASELESS, IDEOGRAPH, TO, SPACE, OPEN, BRACKET), state)
            rule(state, (CLOSE,), IN)
        elif state in (S, SQ, SM, SMQ):
            rule(state, (CLOSE,), SMQ if quoted else SM)
            rule(state, (BRACKET,), state)
            rule(state, (SPACE,), {S: SS, SQ: SSQ, SM: SMS, SMQ: SMSQ}[state])
        elif state in (SS, SSQ, SMS, SMSQ):
            rule(state, (SPACE,), state)
            rule(state, BEGINNERS, IN, True)
            rule(state, (OPEN,), INQ, True)
            rule(state, (CLOSE,), SMQ if quoted else SM)
            if state == SMSQ:
                rule(state, (CASELESS,), IN)
        elif state in (C, CQ, CM, CMQ):
            rule(state, (CLOSE,), CMQ if quoted else CM)
            rule(state, (BRACKET,), state)
            rule(state, (SPACE,), {C: CS, CQ: CSQ, CM: CMS, CMQ: CMSQ}[state])
            if state != CMQ:
                rule(state, (*BEGINNERS, LOWER), IN, True)
                rule(state, (OPEN,), INQ, True)
            if state == CM:
                rule(state, (TO,), IN)
        else:
            rule(state, (SPACE,), state)
            rule(state, (*BEGINNERS, LOWER), IN, True)
            rule(state, (OPEN,), INQ, True)
            if state == CMSQ:
                rule(state, (CASELESS,), IN)
    return step, begins


STEP, BEGINS = _machine()


def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if ch.isspace():
            table[c] = SPACE
        elif cat in ("Cf", "Mn", "Me"):
            table[c] = CLEAR
        elif cat == "Ll":
            table[c] = LOWER
        elif cat in ("Lu", "Lt", "Nd"):
            table[c] = STARTER
        elif cat in ("Lo", "Lm", "Mc"):
            table[c] = IDEOGRAPH if 0x3005 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF or c >= 0x20000 or 0xF900 <= c <= 0xFAFF else CASELESS
        elif cat in ("Ps", "Pi"):
            table[c] = OPEN if cat == "Pi" or ch in "„‚「『〝" else STARTER
        elif cat in ("Pf", "Pe"):
            table[c] = CLOSE if cat == "Pf" or ch in "」』〞" else BRACKET
    for ch in "¿¡#>":
        table[ord(ch)] = STARTER
    for ch in ".!?…؟۔":
        table[ord(ch)] = STOP
    for ch in "。！？．｡।॥":
        table[ord(ch)] = FULL
    table[ord("と")] = TO
    table[ord("«")], table[ord("»")] = OPEN, CLOSE
    return table


TABLE = _classes()

# Abbreviations after which a sentence goes on, whatever follows. Titles, references, and words of
# German, French, Spanish, Italian, Portuguese, Dutch, Polish, Czech, Turkish, Russian and Greek.
ABBREVIATIONS = """
Mr Mrs Ms Messrs Dr Prof Rev Hon St Capt Lt Col Gen Gov Sen Rep Sgt Cpl Maj Adm Cmdr Supt
Abb Abs Art Bd Eq Fig Figs Mag Nr Ref Sect Sec Tab Vol
abb al app approx Approx art bd ca cap cf Cf ch chap dept ed eds env esp est etw ff fig figs incl excl op pag pp ref resp sec sect tab viz vgl Vgl vol vs
bzw Bzw evtl ggf ggfs inkl exkl zzgl Dipl Ing Hr Fr Frl Hrsg
Mlle Mme MM Mmes Mlles Mgr
Dra Sr Sra Sres Sras Dña Ud Uds Lic Gral núm pág págs aprox EE UU ej
Sig Sigg Dott Avv Geom Rag pagg
Exmo Exma Eng
bijv Bijv dhr mevr Dhr Mevr drs blz
zob Zob rys ul dr inż mgr tj np tzw tzn wg
např tzv obr
Doç Yrd Av bkz Bkz
рис табл см стр гл ср им др проф акад илл напр тел обл доц
βλ πίν πιν αρ εικ σελ κεφ κ δρ
""".split()
# After these a number stands and the sentence goes on.
BEFORE_NUMBERS = "No no num art p pp n nº Bl Bd тыс".split()
# German words after which a number with a stop is an ordinal, and months.
BEFORE_ORDINALS = "der die das dem den des am im vom zum zur beim ab bis seit".split()
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()

DOT = regex.compile(r"\.")
LOUD = regex.compile(r"(?<=[\p{L}\p{Nd})\]])[!?](?=\p{Lu})")
ABBREVIATED, NUMBERED = frozenset(ABBREVIATIONS), frozenset(BEFORE_NUMBERS)
ORDINAL, MONTH = frozenset(BEFORE_ORDINALS), tuple(MONTHS)
TIME_OF_DAY = ("a.m", "p.m", "A.M", "P.M")
MIXED = regex.compile(r"(?<![\p{L}\p{N}])\p{Ll}{1,2}(?=\p{Lu})")
STRAIGHT = regex.compile(r'"')
GERMAN_CLOSE = regex.compile(r"(?<=\S)“(?=[\s,.;:!?)\]]|$)")
LINE = r"(?>\r\n|\n|\r)"
EMPTY_LINE = regex.compile(rf"{LINE}[^\S\r\n]*(?={LINE})")
MARKER = regex.compile(r"[^\S\r\n]*(?:[-*•–—‣]|\p{Nd}{1,3}[.)]|\p{Ll}\)|\(\p{Nd}{1,3}\)|\(\p{Ll}\))[^\S\r\n]+\S")
BULLET = regex.compile(r"[^\S\r\n]*[-*•‣][^\S\r\n]+\S")
LINES = regex.compile(rf"[^\r\n]+(?:{LINE})?")
FIGURES = regex.compile(r"[^\S\r\n]*[^\s]+(?:(?:\t| {2,})[-+]?\p{Nd}[\p{Nd}.,eE+%-]*)+[^\S\r\n]*(?:[\r\n]|$)")
GREEK_MARK = regex.compile(r";(?=[\s»\")]|$)")
GREEK = regex.compile(r"\p{Greek}")
THAI = "ก-ฺเ-๎"
THAI_PAUSE = regex.compile(rf"(?<=[{THAI}]\p{{Cf}}*)[   ](?=[   ]*\p{{Cf}}*[{THAI}])")
ANY_THAI = regex.compile(rf"[{THAI}]")
HEADING = regex.compile(r"#{1,6}\s")
NOT_SPACE = regex.compile(r"\S")


def _goes_on(text: str, i: int) -> bool:
    """Whether the stop at i belongs to an abbreviation, an initial or an ordinal, so that the sentence goes on."""
    j = i
    while j and i - j < 24 and ((c := text[j - 1]).isalpha() or c in ".-" or "\u0900" <= c <= "\u0963"):
        j -= 1
    if i and text[i - 1] == ".":
        return False
    word = text[j:i].lstrip(".-")
    j = i - len(word)
    prior = text[j - 1] if j else " "
    if not word:
        if not prior.isdigit():
            return False
        k = j
        while k and text[k - 1].isdigit():
            k -= 1
        if j - k > 2 or (k and text[k - 1] in ".,"):
            return False
        rest = text[i + 1 : i + 40].lstrip()
        return rest.startswith(MONTH) or (rest[:1].isupper() and (text[max(0, k - 12) : k].split() or [""])[-1].lower() in ORDINAL and text[k - 1].isspace())
    if "\u0900" <= word[-1] <= "\u0963":
        return True
    if prior.isdigit():
        return False
    if word in ABBREVIATED:
        return True
    if word in NUMBERED and text[i + 1 : i + 20].lstrip()[:1].isdigit():
        return True
    if len(word) == 1:
        if prior in "°%'’_-" or text[max(0, j - 2) : j] in ("% ", "%\u00a0", "%\u202f", "%\n"):
            return False
        # a letter after a number is a unit, with which a sentence may end
        return not (text[max(0, j - 4) : j].rstrip(" \u00a0\u202f")[-1:].isdigit() and text[i + 1 : i + 20].lstrip()[:1].isupper())
    if "." in word:
        return not word.endswith(TIME_OF_DAY) and all(len(x) <= 1 for x in word.replace("-", ".").split("."))
    return False


def classes(text: str) -> np.ndarray:
    """The class of each letter, as its neighbours make it."""
    kind = TABLE[np.frombuffer(text.encode("utf-32-le"), np.uint32)].copy()
    n = len(text)
    for m in DOT.finditer(text):
        i = m.start()
        c = text[i + 1] if i + 1 < n else " "
        if c.isupper():
            if i + 2 < n and text[i + 2].islower() and i and ((p := text[i - 1]).islower() or p in ")]%”»" or text[i - 2 : i - 1] == "°"):
                kind[i] = FULL
        elif not c.isalnum() and _goes_on(text, i):
            kind[i] = OTHER
    for m in MIXED.finditer(text):
        kind[m.start()] = STARTER
    for m in LOUD.finditer(text):
        kind[m.start()] = FULL
    if '"' in text:
        for m in STRAIGHT.finditer(text):
            i = m.start()
            kind[i] = OPEN if i == 0 or text[i - 1].isspace() or text[i - 1] in "([{" else CLOSE
    if "“" in text and "„" in text:
        for m in GERMAN_CLOSE.finditer(text):
            kind[m.start()] = CLOSE
    if ANY_THAI.search(text):
        for m in THAI_PAUSE.finditer(text):
            kind[m.start()] = PAUSE
    at = 0
    for m in [*EMPTY_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        _block(text, at, end, kind)
        if m:
            kind[m.start()] = BLANK
            at = m.end()
    return kind


def _block(text: str, at: int, end: int, kind: np.ndarray) -> None:
    """Classes in one block between blank lines: records, headings, tables and list items are units."""
    if not (m := NOT_SPACE.search(text, at, end)):
        return
    first = m.start()
    line = text.rfind("\n", at, first) + 1 or at
    if text[first] == ">" or HEADING.match(text, first) or FIGURES.match(text, first, end):
        kind[first:end] = OTHER
        return
    listed = bool(MARKER.match(text, line, end))
    for m in LINES.finditer(text, line, end):
        if (MARKER if listed else BULLET).match(text, m.start(), end):
            kind[m.start() : end] = np.where(kind[m.start() : end] == SPACE, SPACE, OTHER)
            kind[NOT_SPACE.search(text, m.start(), end).start()] = ITEM
    if ";" in text and len(GREEK.findall(text, at, end)) >= 10:
        for m in GREEK_MARK.finditer(text, at, end):
            if kind[m.start()] == OTHER and not listed:
                kind[m.start()] = STOP


def split(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Start and end of each sentence of each text."""
    kinds = [classes(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in kinds])]).astype(np.int64)
    every = np.concatenate(kinds) if kinds else np.zeros(0, np.uint8)
    before, _ = run(every, offsets, STEP, OUT)
    begins = BEGINS[before, every]
    # a sentence ends where nothing more is begun: at the next beginning or where the automaton is outside again
    out = []
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        starts = np.nonzero(begins[a:b])[0]
        outs = np.nonzero((every[a:b] == BLANK) | (every[a:b] == PAUSE))[0]
        stops = np.append(starts[1:], b - a)
        if len(outs) and len(starts):
            nxt = np.searchsorted(outs, starts)
            cut = np.where(nxt < len(outs), outs[np.minimum(nxt, len(outs) - 1)], b - a)
            stops = np.minimum(stops, cut)
        spans = []
        for s, e in zip(starts.tolist(), stops.tolist()):
            e = s + len(text[s:e].rstrip())
            if e > s:
                spans.append((s, e))
        out.append(spans)
    return out


def sentences(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id_col, sent_start, sent_end of each sentence of each text, in code points.

    Null, empty and blank texts have none. Repeated rows come out once each, other columns are ignored, texts are
    read whole whatever their length. With `with_text` the sentence itself comes too. Only a scan and a projection:
    nothing is shuffled.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", most=2_000_000):
            values = [t or "" for t in batch.column(1).to_pylist()]
            found = split(values)
            row = np.repeat(np.arange(len(values)), [len(f) for f in found])
            flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
            cols = [batch.column(0).take(pa.array(row)), pa.array(flat[:, 0]), pa.array(flat[:, 1])]
            if with_text:
                cols.append(pa.array([values[r][a:b] for r, (a, b) in zip(row.tolist(), flat.tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "sent_start", "sent_end"] + ["sentence"] * with_text)

    schema = f"_id {texts.schema[id_col].dataType.simpleString()}, sent_start bigint, sent_end bigint" + ", sentence string" * with_text
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(go, schema).withColumnRenamed("_id", id_col)
