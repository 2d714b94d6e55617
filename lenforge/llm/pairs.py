"""Problem 1: instruction–response pairs whose response is no usable answer, with the type of defect.

empty           nothing that answers: no letters or digits, or a placeholder for a missing answer
copy            a suffix automaton of the instruction's words is traversed with the response; most of it is covered by copied runs
refusal         phrase automata find sentences that decline, and no sentence answers
wrong_language  votes of function words (or the script) name another language than the instruction's or the one it asks for
truncated       a stack of delimiters stays open, a list ends in an empty item, or the last words break off

A last sentence without a final mark is judged by a linear model of sentence ends (``EndModel``), fitted in one task on sentences labelled
whole or cut, of a bounded sample of responses (``SAMPLE_ROWS`` of at most ``SAMPLE_CHARS`` characters, chosen by a hash of the key): it separates a
missing mark from a sentence that breaks off. The words it knows are counted over the complete sentences of all responses and reach it as bits of a
fixed number. A fitted model may be saved and given to ``broken_pairs`` again, so that verdicts on old rows stay when rows come in.

A pair has one defect at most, the first in the order above. Defined results: a null response is empty; a null instruction asks
for nothing (no copy, no language); a sample delivered repeatedly counts once (earliest loaded); rows of null key are left out; texts are
read whole; further columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lenforge.llm import phrases as P

SAMPLE_ROWS, SAMPLE_CHARS = 3000, 1 << 15
DIMS = 1 << 18
#: Words a counting task holds before it hands on its counts.
HELD_WORDS = 1_000_000
#: Log-odds from which a fragment without a final mark counts as broken off.
CUT_ABOVE = 1.0
_WORD = re.compile(r"\w+(?:['’]\w+)?")
_TAGS = re.compile(r"<[^<>]{0,60}>")
_FENCED = re.compile(r"```.*?```", re.S)
_FINAL = ".!?؟。…‽"
_SENTENCE = re.compile(r"(?<=[.!?؟。…])[\"'”’»)\]]*\s+|\n+")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+")
#: A line of only a list mark, with what marks up its text at most; and the mark of a line that has text.
_BARE = re.compile(r"(?:^|\n)[^\S\n]*([-*•–]|(?:\d{1,3}|[A-Za-z])[.)])[^\S\n]*[*_`\"“«(\[]*\Z")
_MARKED = re.compile(r"^[^\S\n]*([-*•–]|(?:\d{1,3}|[A-Za-z])[.)])[^\S\n]+\S", re.M)
#: Brackets that open nothing: faces, single quoted ones and code, intervals that are open at one end.
_NO_BRACKET = re.compile(r"(?<!\S)[:;]['’]?-?[(\[{]+(?!\S)|`[^`\n]*`|([\"'])[()\[\]{}]\1|[“‘«][()\[\]{}][”’»]|\([^()\[\]\n]{1,40},[^()\[\]\n]{1,40}\]|\[[^()\[\]\n]{1,40},[^()\[\]\n]{1,40}\)|\][^()\[\]\n]{1,40},[^()\[\]\n]{1,40}\[")
# Words that end no answer.
_JOINING = frozenset("the of and or a an to with for from by at in der die das und oder ein eine mit von zu für des et ou le les de du dans pour avec une y o el los las un una del con para por".split())
_ARABIC = re.compile(r"[؀-ۿ]+")
_SPACES, _UNEVEN = re.compile(r"[^\S\n]+"), re.compile(r"[^\S\n ]|  ")
_BRACKETS = re.compile(r"[()\[\]{}]")
_MARKS = frozenset(".,;:!?؟،؛…。–—-()[]{}<>\"'”’»«“`=+*/\\|&@#%$_")
#: What may stand after the last sentence without belonging to it: a link, a short remark in brackets or quotes.
_ASIDE = re.compile(r"(?:https?://\S+|\([^()]{1,30}\)|[\"“«][^\"“”«».!?]{1,12}[\"”»])\Z")


# --- copied coverage -------------------------------------------------------------------------------------------------


class SuffixAutomaton:
    """All runs of a word sequence; ``walk`` gives the longest run of it that ends at each word of another sequence."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for i, w in enumerate(words):
            cur = self._state(self.length[last] + 1, {}, i)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]), self.end[q])
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def _state(self, length: int, moves: dict[str, int], end: int) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)
        return len(self.length) - 1

    def walk(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(length of the run that ends here, where it first ends in the automaton's own sequence)."""
        state = run = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                run += 1
            else:
                run = 0
            yield run, self.end[state]


def copied(instruction: list[str], response: list[str], least: int = 2) -> tuple[float, set[int]]:
    """Share of the response's words in runs of ``least`` or more words of the instruction; the instruction's positions met."""
    covered, met = set(), set()
    for i, (run, end) in enumerate(SuffixAutomaton(instruction).walk(response)):
        if run >= least:
            covered.update(range(i - run + 1, i + 1))
            met.update(range(end - run + 1, end + 1))
    return len(covered) / max(1, len(response)), met


@lru_cache(maxsize=None)
def _repeat_request() -> tuple[re.Pattern[str], re.Pattern[str], re.Pattern[str]]:
    any_of = lambda words: "|".join(re.escape(w.rstrip()) + (r"(?!\w)" if w.endswith(" ") else "") for w in words)
    verb, opener = rf"[وف]?(?:{any_of(P.ASKS_REPEAT)})", "|".join(map(re.escape, P.OPENERS.split()))
    leads = rf"(?:^|[,;،(\"“«-]|(?<!\w)(?:and|then|und|et|y|ثم)(?!\w))\W*(?:(?:{opener})(?!\w)\W*)*{verb}"
    return re.compile(leads), re.compile(rf"(?<!\w)[وفب]?(?:{any_of(P.REPEAT_HOW)})"), re.compile(rf"^\W*(?:{any_of(P.VERB_LAST)})(?!\w).*(?<!\w){verb}")


def asks_repeat(low: str) -> bool:
    """Whether the request (the sentence before the first colon, the first or the last sentence) asks for the same, or nearly the same, text."""
    at = low.find(":")
    lead = _SENTENCE.split(low[:at])[-1:] if at >= 0 else []
    parts = [s for s in _SENTENCE.split(low) if s and s.strip()]
    leads, how, verb_last = _repeat_request()
    return any(leads.search(s) or how.search(s) or verb_last.search(s) for s in (*lead, *parts[:1], *parts[-1:]))


def is_copy(instruction: str, low: str, asked: list[str], words: list[str]) -> bool:
    if asked and words[:1] == ["instruction"]:
        words = words[1:]
    n, m = len(asked), len(words)
    if not n or not m:
        return False
    if m * 2 < n:
        # A part of the instruction is a copy only if it is its beginning: other parts may be what was asked for.
        return m > 2 and words == asked[:m] and not asks_repeat(low)
    # Changed words are looked for in answers about as long as the instruction; a longer one gives back nothing else.
    least = 0.55 if m <= 1.25 * n + 4 and min(n, m) > 3 else 0.95
    # Only words of the instruction can be covered: most answers hold too few of them, whatever their order.
    if sum(map(set(asked).__contains__, words)) < least * m:
        return False
    share, met = copied(asked, words, min(2, n))
    if share < least:
        return False
    head = instruction.find(":")
    lead = len(_WORD.findall(instruction[:head])) if head >= 0 else 0
    if 0 < lead <= 14 and n - lead >= 4:
        # An instruction that hands over a text: giving back the text alone is judged by what was asked.
        if sum(k in met for k in range(lead)) < max(2, lead / 2):
            return False
        return True
    return not asks_repeat(low)


# --- phrases ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def automaton(name: str) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    if name == "DECLINE":
        # Parts bear (template, side), idioms stand for a whole template.
        found: dict[str, list[tuple[int, int]]] = {}
        for t, sides in enumerate(P.DECLINE_PARTS):
            for side, phrases in enumerate(sides):
                for p in phrases:
                    found.setdefault(f" {p}" if p.isascii() or side == 0 else p, []).append((t, side))
        for p in P.DECLINE_IDIOMS:
            found.setdefault(p, []).append((-1, 1))
        for p, marks in found.items():
            auto.add_word(p, (len(p), marks))
    else:
        rare = [p for t, sides in enumerate(P.DECLINE_PARTS) for p in sides[P.RARER_SIDE[t]]] if name == "RARE" else []
        for p in [*rare, *P.DECLINE_IDIOMS] if rare else getattr(P, name):
            auto.add_word(p, p)
    auto.make_automaton()
    return auto


def finds(name: str, text: str) -> bool:
    return next(automaton(name).iter(text), None) is not None


@lru_cache(maxsize=None)
def _adverbs() -> re.Pattern[str]:
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, P.ADVERBS))})(?!\w)[, ]*")


#: Characters that may lie between the parts of a refusal: an object, "to", "you with".
BETWEEN = 24


def declines(clause: str) -> bool:
    """Whether a clause holds an idiom, or a first part and soon after it a second part of one template."""
    text = " " + re.sub(r"[\s,]+", " ", _adverbs().sub("", clause))
    ends: dict[int, int] = {}
    for end, (length, marks) in automaton("DECLINE").iter(text):
        # A first part ends with its word.
        whole = end + 1 == len(text) or not text[end + 1].isalnum()
        for template, side in marks:
            if side == 1 and (template < 0 or 0 <= end - length + 1 - ends.get(template, -1000) <= BETWEEN):
                return True
        for template, side in marks:
            if side == 0 and whole:
                ends[template] = end + 1
    return False


def fold(text: str) -> str:
    """Lower case, plain apostrophes, single spaces inside lines."""
    low = text.lower().replace("’", "'")
    return _SPACES.sub(" ", low) if _UNEVEN.search(low) else low


def is_refusal(low_instruction: str, low: str) -> bool:
    clauses = [s for s in re.split(r"[.!?؟…;\n]+", low) if s.strip()]
    if not any(map(declines, clauses)) or finds("ASKS_REFUSAL", low_instruction):
        return False
    for s in clauses:
        if len(_WORD.findall(s)) > 2 and not declines(s) and not finds("REDIRECT", s):
            return False
    return True


# --- languages -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def _votes() -> dict[str, tuple[str, ...]]:
    by: dict[str, list[str]] = {}
    for lang, words in P.STOPWORDS.items():
        for w in words.split():
            by.setdefault(w, []).append(lang)
    return {w: tuple(v) for w, v in by.items()}


@lru_cache(maxsize=None)
def _names() -> dict[str, str]:
    return {w: lang for lang, words in P.LANGUAGE_NAMES.items() for w in words.split()}


@lru_cache(maxsize=None)
def _scripts() -> tuple[re.Pattern[str], dict[str, re.Pattern[str]]]:
    return re.compile(f"[{''.join(P.SCRIPTS.values())}]+"), {lang: re.compile(f"[{letters}]") for lang, letters in P.SCRIPTS.items()}


def language(text: str, words: list[str]) -> str | None:
    """The language of the script most letters belong to, or else of most function words; None without a clear majority."""
    other, by_script = _scripts()
    if not text.isascii() and (found := len(letters := "".join(other.findall(text)))) >= 8 and found * 2 > sum(map(str.isalpha, text)):
        # Japanese mixes its own letters with Chinese ones.
        counts = {}
        for lang, p in by_script.items():
            counts[lang] = len(p.findall(letters)) + (counts["zh"] if lang == "ja" and counts["zh"] * 2 <= found * 1.8 else 0)
            if counts[lang] * 2 > found and lang != "zh":
                return lang
        return "zh" if counts["zh"] * 2 > found else None
    if len(words) < 4:
        return None
    score: dict[str, float] = {}
    for voted, times in Counter(map(_votes().get, words)).items():
        for lang in voted or ():
            score[lang] = score.get(lang, 0.0) + times / len(voted)
    best = max(score, key=score.get, default=None)
    second = max((v for k, v in score.items() if k != best), default=0.0)
    return best if best and score[best] >= 2 and score[best] >= 1.25 * second else None


def asked_languages(low_instruction: str, asked: list[str]) -> set[str]:
    found: set[str] = set()
    if _names().keys().isdisjoint(asked):
        return found
    for m in _WORD.finditer(low_instruction):
        lang = _names().get(m.group())
        if lang and not low_instruction[: m.start()].rstrip().endswith(P.NOT_BEFORE):
            before = low_instruction[max(0, m.start() - 14) : m.start()].split()
            # Asked for: "in French", "auf Französisch", "the French version", "باللغة الفرنسية".
            if before and before[-1] in ("in", "into", "ins", "auf", "en", "au", "al", "the", "to", "باللغة", "إلى", "zu", "nach", "vers", "a"):
                found.add(lang)
    return found


def is_wrong_language(low_instruction: str, asked: list[str], prose: str, words: list[str]) -> bool:
    got = language(prose, words)
    if got is None:
        return False
    want = asked_languages(low_instruction, asked)
    if not want:
        own = language(low_instruction, asked)
        if own is None:
            return False
        want = {own}
    return got not in want


# --- broken ends -----------------------------------------------------------------------------------------------------


def open_delimiters(text: str) -> bool:
    """Whether a bracket that opens in the text never closes."""
    pairs = {")": "(", "]": "[", "}": "{"}
    stack: list[str] = []
    for ch in _BRACKETS.findall(text):
        if ch in "([{":
            stack.append(ch)
        elif ch in pairs and stack and stack[-1] == pairs[ch]:
            stack.pop()
    return bool(stack)


def empty_item(text: str) -> bool:
    """Whether a list ends in a mark without text: the next number or letter, or the mark of the item before it."""
    m = _BARE.search(text, max(0, len(text) - 40))
    before = _MARKED.findall(text[: m.start()]) if m else []
    if not before:
        return False
    mark, prior = m.group(1), before[-1]
    if mark == prior or mark[-1] != prior[-1]:
        return mark == prior
    a, b = prior[:-1], mark[:-1]
    return int(b) == int(a) + 1 if a.isdigit() and b.isdigit() else len(a) == len(b) == 1 and ord(b) == ord(a) + 1


def last_fragment(text: str) -> str:
    """The last sentence or item, without its marker."""
    parts = [p for p in _SENTENCE.split(text) if p and p.strip()]
    return _ITEM.sub("", parts[-1]).strip() if parts else ""


def _shape(words: list[str]) -> list[str]:
    out = []
    for k, w in enumerate(words):
        if not w.isalpha() and any(c.isdigit() for c in w):
            out.append("#")
        elif k and w[:1].isupper():
            out.append("N")
        else:
            out.append(w.lower())
    return out


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


#: Bits of the vocabulary: its size whatever the corpus. A word shares its bit with another one of n words with a chance of about n / VOCABULARY_BITS.
VOCABULARY_BITS = 1 << 26


class Vocabulary:
    """Words by bits of a fixed number; a few unknown words may count as known, never the other way round."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __contains__(self, word: str) -> bool:
        h = word_hash(word) % VOCABULARY_BITS
        return bool(int(self.bits[h >> 6]) >> (h & 63) & 1)


def end_features(fragment: str, known: Container[str]) -> list[int]:
    """Hashed features of how a fragment ends."""
    words = fragment.split()
    s = ["^", "^", "^", *_shape(words)]
    last = words[-1] if words else ""
    opening = " ".join(s[3:5])
    n = min(len(words), 40)
    tail = s[-1] if s[-1] in known or s[-1] in "#N" else "?"
    raw = (
        f"a{s[-1]}", f"b{s[-2]} {s[-1]}", f"c{s[-3]} {s[-2]} {s[-1]}", f"d{last[-3:]}", f"e{tail}", f"f{opening}|{n}", f"g{s[3] if words else ''}|{n}", f"h{opening}|{tail}", f"i{s[-2]}|{tail == '?'}", f"j{opening}|{s[-2]}|{tail == '?'}", f"k{min(len(last), 12)}|{tail == '?'}", f"l{n}",
    )
    return [zlib.crc32(f.encode("utf-8", "replace")) % DIMS for f in raw]


def sentences_of(text: str) -> list[str]:
    """Complete sentences, without their final mark."""
    prose = _FENCED.sub("\n", text)
    out = []
    for s in _SENTENCE.split(prose):
        s = _ITEM.sub("", s or "").strip()
        if len(s) > 12 and s[-1] in _FINAL and not s.endswith("...") and len(s.split()) >= 4:
            out.append(s.rstrip(_FINAL))
    return out


def count_words(seen: dict[str, tuple[int, int] | None], key: int, row: int, text: str) -> None:
    """Notes the words of complete sentences by the row that holds them; None once a word is seen again, other than in a repeated row."""
    for s in sentences_of(text):
        for w in _shape(s.split()):
            at = seen.get(w, ())
            if at == ():
                seen[w] = key, row
            elif at is not None and (at[0] != key or at[1] == row):
                seen[w] = None


def vocabulary(samples: DataFrame, key: str) -> Vocabulary:
    """Words that complete sentences of all responses hold more than once; a sample delivered repeatedly counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, int] | None] = {}
        row = 0

        def counts() -> pa.RecordBatch:
            hashes, at = [word_hash(w) for w in seen], list(seen.values())
            keys = pa.array([None if a is None else a[0] for a in at], pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), keys], names=["word", "key"])
            seen.clear()
            return out

        for batch in batches:
            for k, text in zip(batch.column("key").to_pylist(), batch.column("response").to_pylist(), strict=True):
                row += 1
                count_words(seen, k, row, text)
                if len(seen) >= HELD_WORDS:
                    yield counts()
        yield counts()

    rows = samples.where(F.col(key).isNotNull() & F.col("response").isNotNull()).select(F.xxhash64(key).alias("key"), "response")
    words = rows.mapInArrow(run, "word bigint, key bigint").groupBy("word")
    again = words.agg(F.bool_or(F.col("key").isNull()).alias("again"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("again OR lo <> hi")
    # At most VOCABULARY_BITS / 64 rows reach the driver.
    bit = again.select(F.pmod("word", F.lit(VOCABULARY_BITS)).alias("bit"))
    cells = bit.groupBy(F.expr("shiftright(bit, 6)").cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(VOCABULARY_BITS // 64, dtype=np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return Vocabulary(out)


def fit_ends(texts: list[str], seed: int = 5, rounds: int = 80, known: Container[str] | None = None) -> tuple[np.ndarray, Container[str]]:
    """Weights of a logistic model (positive: broken off), and the words it knows: ``known``, or those the texts hold more than once."""
    rng = np.random.default_rng(seed)
    whole = [s for t in texts for s in sentences_of(t)]
    if known is None:
        seen: dict[str, tuple[int, int] | None] = {}
        for i, t in enumerate(texts):
            count_words(seen, i, i, t)
        known = {w for w, at in seen.items() if at is None}
    rows, labels = [], []
    for s in whole:
        words = s.split()
        rows.append(end_features(s, known))
        labels.append(0.0)
        # Cut after a word, and inside a word.
        k = int(rng.integers(1, len(words)))
        rows.append(end_features(" ".join(words[:k]), known))
        labels.append(1.0)
        k = int(rng.integers(0, len(words)))
        if len(words[k]) > 2:
            part = words[k][: int(rng.integers(1, len(words[k])))]
            rows.append(end_features(" ".join([*words[:k], part]), known))
            labels.append(1.0)
    weights = np.zeros(DIMS, dtype=np.float64)
    if not rows:
        return weights.astype(np.float32), known
    x, y = np.array(rows, dtype=np.int64), np.array(labels)
    used, flat = np.unique(x, return_inverse=True)
    flat = flat.reshape(x.shape)
    # Whole sentences weigh as much as cut ones.
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, adapt = np.zeros(len(used)), np.full(len(used), 1e-6)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-w[flat].sum(axis=1))) - y) * weight
        grad = np.bincount(flat.ravel(), weights=np.repeat(error, x.shape[1]), minlength=len(used)) / len(y) + 1e-7 * w
        adapt += grad * grad
        w -= 0.4 * grad / np.sqrt(adapt)
    weights[used] = w
    return weights.astype(np.float32), known


def _trimmed(body: str) -> str:
    """Without pictures and white space at the end, and without an aside after a finished sentence."""
    while True:
        n = len(body)
        while n and not (body[n - 1].isalnum() or body[n - 1] in _MARKS):
            n -= 1
        body = body[:n]
        # An aside is short or a link: it lies in the last word, or in the last 32 characters.
        at = max(body.rfind(" "), body.rfind("\n"))
        m = _ASIDE.search(body, max(0, min(at, n - 32)))
        before = body[: m.start()].rstrip() if m else ""
        if not before or before[-1] not in _FINAL + ":\"'”’»)`":
            return body
        body = before


def _breaks_off(body: str, known: Container[str]) -> bool:
    """Whether a few words break off, as whole answers may be as short: inside a word (known words, then an unknown one in small letters), or after a word that only joins others."""
    words = body.split()
    shape = _shape(words)
    if len(words) < 2 or not words[-1].isalpha() or shape[-1] == "N":
        return False
    if _ARABIC.search(words[-1]):
        # Names have no capitals there.
        return False
    return shape[-1] in _JOINING or (shape[-1] not in known and all(w in known or w in "#N" for w in shape[:-1]))


def is_truncated(text: str, n_words: int, weights: np.ndarray, known: Container[str]) -> bool:
    body = text.strip()
    if "```" in body:
        if body.count("```") % 2:
            return True
        body = _FENCED.sub("\n", body)
        if _trimmed(text).endswith("```"):
            return False
    if body[:1] in "{[" and len(body) > 1:
        try:
            json.loads(body)
            return False
        except ValueError:
            if open_delimiters(body):
                return True
    body = _trimmed(body)
    # Dots that stand for what is missing end no sentence: the words before them decide.
    if body.endswith(("…", "...")):
        body = body.rstrip("….").rstrip()
    if not body:
        return False
    if empty_item(body) or open_delimiters(_NO_BRACKET.sub("", body)):
        return True
    last = body[-1]
    if last in ",،;؛–—(":
        return True
    if last in _FINAL:
        return False
    if n_words <= 4:
        return _breaks_off(body, known)
    # The last sentence, found from the end in growing windows.
    window = 400
    while window < len(body) and len([p for p in _SENTENCE.split(body[-window:]) if p and p.strip()]) < 2:
        window *= 2
    fragment = last_fragment(body[-window:])
    bare = fragment.rstrip("\"'”’»)]* ")
    if not bare or bare[-1] in _FINAL:
        return False
    if last == "-" or last == ":":
        return True
    return float(weights[end_features(bare, known)].sum()) > CUT_ABOVE


# --- the operator ----------------------------------------------------------------------------------------------------


def _bare_words(low: str) -> str:
    """The words of a text outside tags, as far as a placeholder may be long."""
    out, length = [], 0
    for m in _WORD.finditer(_TAGS.sub(" ", low) if "<" in low else low):
        out.append(m.group())
        length += len(out[-1]) + 1
        if length > 60:
            break
    return " ".join(out)


def defect(instruction: str | None, response: str | None, weights: np.ndarray, known: Container[str]) -> str | None:
    """The defect of one pair, or None."""
    instruction, response = instruction or "", response or ""
    low = response.lower()
    bare = _bare_words(low)
    if not bare or (bare in P.PLACEHOLDERS and not (bare == "none" and instruction.lower().lstrip(" ¿").startswith(P.CHOICE))):
        return "empty"
    prose = _FENCED.sub("\n", low) if "```" in low else low
    words = _WORD.findall(prose)
    low_instruction = fold(instruction)
    asked = _WORD.findall(low_instruction)
    if is_copy(instruction, low_instruction, asked, words):
        return "copy"
    folded = fold(prose)
    if finds("RARE", folded) and is_refusal(low_instruction, folded):
        return "refusal"
    if is_wrong_language(low_instruction, asked, prose, words):
        return "wrong_language"
    if is_truncated(response, len(words), weights, known):
        return "truncated"
    return None


@dataclass(frozen=True)
class EndModel:
    """What judges sentence ends: weights of hashed features, and the known words."""

    weights: np.ndarray
    known: Container[str]

    def save(self, path: str) -> None:
        np.savez_compressed(path, weights=self.weights, bits=self.known.bits)

    @staticmethod
    def read(path: str) -> EndModel:
        with np.load(path) as f:
            return EndModel(f["weights"], Vocabulary(f["bits"]))


def end_model(samples: DataFrame, key: str = "sample_id", sample_rows: int = SAMPLE_ROWS) -> EndModel:
    """Fits the model of sentence ends; the weights in one task, as their sample is bounded in rows and characters."""
    named = samples.where(F.col(key).isNotNull())
    known = vocabulary(named, key)
    # The bound on the hash is found on the keys alone, so that tasks send no more texts than the sample holds.
    hashed = F.xxhash64(key)
    top = named.select(hashed.alias("_h")).orderBy("_h").limit(sample_rows).agg(F.max("_h").alias("h")).first()["h"]
    if top is None:
        return EndModel(np.zeros(DIMS, dtype=np.float32), known)
    chosen = named.where((hashed <= F.lit(top)) & (F.length("response") <= SAMPLE_CHARS)).select(hashed.alias("_h"), "response")
    shared = samples.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(zip(*(sum((b.column(k).to_pylist() for b in batches_), []) for k in range(2)), strict=True)) if (batches_ := list(batches)) else []
        # A sample delivered more often than expected does not widen the bound.
        weights, _ = fit_ends([r for _, r in rows[: 2 * sample_rows]], known=shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    got = chosen.repartition(1).mapInArrow(run, "weights binary").first()
    return EndModel(np.frombuffer(got["weights"], dtype=np.float32) if got else np.zeros(DIMS, dtype=np.float32), known)


def broken_pairs(samples: DataFrame, key: str = "sample_id", sample_rows: int = SAMPLE_ROWS, model: EndModel | None = None) -> DataFrame:
    """(sample_id, defect) of each defective pair of ``samples``: sample_id, instruction, response [, loaded_at]."""
    named = samples.where(F.col(key).isNotNull())
    order = [F.col("loaded_at")] if "loaded_at" in samples.columns else []
    shared = samples.sparkSession.sparkContext.broadcast(model or end_model(samples, key, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = shared.value
        for batch in batches:
            found = [defect(i, r, ends.weights, ends.known) for i, r in zip(batch.column("instruction").to_pylist(), batch.column("response").to_pylist(), strict=True)]
            columns = [batch.column("id"), pa.array(found, pa.string())] + [batch.column(c) for c in batch.schema.names[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "defect", *batch.schema.names[3:]])

    extra = [c.alias("at") for c in order]
    rows = named.select(F.col(key).cast("long").alias("id"), "instruction", "response", *extra)
    kind = ", at " + samples.schema["loaded_at"].dataType.simpleString() if order else ""
    judged = rows.mapInArrow(run, f"id bigint, defect string{kind}")
    # Judged first, so that no text is shuffled to find repeated rows; the earliest row decides.
    first = F.min(F.struct(*(["at"] if order else []), F.coalesce("defect", F.lit("")).alias("defect"))).alias("_r")
    once = judged.groupBy("id").agg(first).select(F.col("id").alias(key), F.col("_r.defect").alias("defect"))
    return once.where("defect <> ''")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/raw_samples.parquet").select("sample_id", "instruction", "response", "loaded_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(_samples(spark, sf_dir))


ORACLES: dict[str, str] = {}
