"""Broken prompt and response pairs (problem 2).

A pair is a User turn and the first AI turn after it and before the next User turn.  Pairs are found
with window functions over (transcript, block of turn numbers), so a transcript that holds a third
of all turns is split over many tasks; only the last state of each block is ordered over a whole
transcript.  Each pair is then aligned in Python: shingle containment and longest common
subsequence against the prompt, and against refusal templates.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: The speaker aliases of the data model.
USER_ALIASES = ("user", "human", "developer")
AI_ALIASES = ("assistant", "ai", "copilot", "claude", "chatgpt", "model")

#: Turn numbers per block of a transcript.
BLOCK = 512


def role(speaker: Column) -> Column:
    """'U', 'A' or 'O', ignoring case and outer white space; null is 'O'."""
    name = F.lower(F.regexp_replace(speaker, r"(?U)^\s+|\s+$", ""))
    return F.when(name.isin(*USER_ALIASES), "U").when(name.isin(*AI_ALIASES), "A").otherwise("O")


def prompt_response_pairs(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(transcript_id, turn_idx, prompt, response): turn_idx is that of the AI turn.

    Turns without transcript or number belong to no pair.  Of a turn delivered several times one
    copy counts.  One shuffle of the turns by (transcript, block) serves the de-duplication, all
    windows and the block states.
    """
    x = turns.where("transcript_id IS NOT NULL AND turn_idx IS NOT NULL").select("transcript_id", "turn_idx", "content", role(F.col("speaker")).alias("role")).where("role <> 'O'")
    x = x.withColumn("block", F.expr(f"floor(turn_idx / {block})"))
    # The number of partitions is left to the session, so that adaptive execution may merge small ones.
    w = Window.partitionBy("transcript_id", "block").orderBy("turn_idx")
    x = x.withColumn("_again", F.lag("turn_idx").over(w)).where("_again IS NULL OR _again <> turn_idx").drop("_again")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    user = F.when(F.col("role") == "U", F.struct("turn_idx", "content"))
    ai = F.when(F.col("role") == "A", F.col("turn_idx"))
    x = x.withColumns({"_user": F.last(user, ignorenulls=True).over(before), "_ai": F.last(ai, ignorenulls=True).over(before)})
    answers = x.where("role = 'A' AND (_ai IS NULL OR _ai < _user.turn_idx)")

    # What the blocks before a block leave open: their last User turn, and whether an AI turn followed it.
    state = x.groupBy("transcript_id", "block").agg(F.max(F.when(F.col("role") == "U", F.struct("turn_idx", "content"))).alias("u"), F.max(F.when(F.col("role") == "A", F.col("turn_idx"))).alias("a"))
    over = Window.partitionBy("transcript_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = state.select("transcript_id", "block", F.last("u", ignorenulls=True).over(over).alias("_cu"), F.max("a").over(over).alias("_ca")).where("_cu IS NOT NULL AND (_ca IS NULL OR _ca < _cu.turn_idx)")
    within = answers.where("_user IS NOT NULL").select("transcript_id", "turn_idx", F.col("_user.content").alias("prompt"), F.col("content").alias("response"))
    across = answers.where("_user IS NULL AND block > 0 OR _user IS NULL AND block < 0").join(carried.drop("_ca"), ["transcript_id", "block"]).select("transcript_id", "turn_idx", F.col("_cu.content").alias("prompt"), F.col("content").alias("response"))
    return within.unionByName(across)


# --- texts ----------------------------------------------------------------------------------------

_FENCE = re.compile(r"(?:```|~~~)[^\n]*\n?.*?(?:```|~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTE_LINE = re.compile(r"(?m)^\s*>.*$")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

#: Function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the a an is are was were be been to of and or that this it its in on for with which what how why when where can could would should do does did not no you your we our my me i at by from as if then than there so into only please add write make all some have has had will about before after let us needs each every any during under",
    "de": "der die das den dem des ein eine einen einem einer ist sind war waren wird werden wurde zu von und oder dass dieser diese dieses es im in auf für mit welche was wie warum wann wo kann könnte würde sollte nicht kein keine du ihr wir unser mein mir ich an bei aus als wenn dann nur bitte auch alle jede jeden jetzt noch nach vor ohne mich dich sich damit deshalb daher weil hier habe hat ergänze",
    "fr": "le la les un une des du est sont était été être de et ou que qui ce cette ces il elle dans sur pour avec quel quelle comment pourquoi quand où peut pourrait faut ne pas vous nous notre mon ma me je au aux par si alors plus sans y en se son sa ses ont puis peux tu chaque soit cela c'est l'ordre d'abord car moi leur dont mais",
    "es": "el la los las un una unos unas es son era fue ser de y o que quien este esta esto estas en sobre para con qué cómo por cuándo dónde puede podría debe no usted nosotros nuestro mi me yo al del si entonces más sin se su sus han puedes cada está lo le como también porque así quien pero ya hay aquí va",
}
_FUNCTION = {w: [] for words in FUNCTION_WORDS.values() for w in words.split()}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _FUNCTION[_w].append(_lang)
_LETTERS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "ç": "fr", "è": "fr", "ê": "fr", "à": "fr", "œ": "fr", "û": "fr"}
#: A request to answer in some language.
_ASKED = re.compile(
    r"(?i)\b(?:in|auf|en|into|to|au|ins)\s+(?:plain\s+|simple\s+)?(english|german|french|spanish|englisch|deutsch|französisch|spanisch|anglais|allemand|français|espagnol|inglés|alemán|francés|español)\b|\b(?:translate|übersetze?|traduis|traduce|traduzca)\b"
)


def prose(text: str) -> str:
    """The running text without code, inline code and quoted lines."""
    text = text.replace("[code block]", " ")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(" ", text)
    if "`" in text:
        text = _INLINE.sub(" ", text)
    return _QUOTE_LINE.sub(" ", text) if ">" in text else text


_SPOKEN = re.compile(r"[a-zß-öø-ÿœ][a-zß-öø-ÿœ'’]*")
_LETTER = re.compile("[" + "".join(_LETTERS) + "]")


def language_votes(text: str) -> dict[str, float]:
    """Function words and typical letters of each language in running text; shared words count in shares."""
    votes: dict[str, float] = {}
    low = prose(text).lower()
    for w in _SPOKEN.findall(low):
        langs = _FUNCTION.get(w)
        if langs:
            for x in langs:
                votes[x] = votes.get(x, 0) + 1 / len(langs)
        elif "'" in w or "’" in w:
            for part in w.replace("’", "'").split("'"):
                for x in _FUNCTION.get(part, ()):
                    votes[x] = votes.get(x, 0) + 1 / len(_FUNCTION[part])
    if not low.isascii():
        for c in _LETTER.findall(low):
            votes[_LETTERS[c]] = votes.get(_LETTERS[c], 0) + 0.5
    return votes


def clear_language(votes: dict[str, float], least: float = 2.0, share: float = 0.6) -> str | None:
    if not votes:
        return None
    best = max(votes, key=votes.get)
    return best if votes[best] >= least and votes[best] >= share * sum(votes.values()) else None


# --- defects --------------------------------------------------------------------------------------

#: Templates of refusals in running text; {w} takes up to four words.
REFUSALS = [
    "i'm sorry but i can't help with that", "i am sorry but i cannot help with this", "i cannot assist with this request", "i can't assist with that", "i'm not able to help with this", "unfortunately i am unable to do this",
    "apologies this is not something i can do", "i won't be able to write this for you", "i will not produce this code", "as an assistant i must decline", "i must decline this request", "i have to decline", "i'd rather not take this on", "i have to pass on this one",
    "that falls outside what i am allowed to do", "it goes against the guidelines i work under", "my instructions do not cover this kind of work", "i refuse to do this",
    "tut mir leid dabei kann ich nicht helfen", "diese anfrage kann ich leider nicht bearbeiten", "das darf ich nicht tun", "das verstößt gegen meine richtlinien", "ich muss diese anfrage ablehnen", "ich kann dir dabei nicht helfen",
    "désolé je ne peux pas vous aider avec cela", "je dois refuser cette demande", "je ne suis pas en mesure de traiter cette demande", "cela va à l'encontre de mes consignes", "je ne peux pas répondre à cette demande",
    "lo siento no puedo ayudar con eso", "tengo que rechazar esta solicitud", "no me es posible atender esta petición", "va en contra de mis normas", "no puedo ayudarte con esto",
]


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("’", "'"))


_TEMPLATES = [tokens(t) for t in REFUSALS]
_TEMPLATE_WORDS = [set(t) for t in _TEMPLATES]
_REFUSAL_CUES = re.compile(
    r"\b(?:can(?:'|no|’)t|cannot|sorry|unable|not able|apolog|declin|refus|rather not|pass on|falls outside|allowed|guidelines|instructions|will not|won['’]t|not something|leider|leid|darf|richtlinien|ablehn|nicht helfen|désolé|refuser|mesure|consignes|ne peux|siento|rechazar|posible|normas|no puedo)"
)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: the rows of the table as bits of one number, one step a word."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def is_refusal(response: str, least: float = 0.85) -> bool:
    """True if some sentence of the answer follows a refusal template.

    A sentence, or as much of its beginning as the template is long, is aligned with the template by
    longest common subsequence: most of the template's words must be in it in order, with little else
    between them.  What a long sentence goes on to say does not matter.
    """
    if not _REFUSAL_CUES.search(response.lower()):
        return False
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", prose(response)):
        words = tokens(sentence)
        seen = set(words)
        for template, vocabulary in zip(_TEMPLATES, _TEMPLATE_WORDS):
            if len(vocabulary & seen) < least * len(vocabulary):
                continue
            if lcs_length(template, words[: len(template) + 4]) >= least * len(template):
                return True
    return False


def shingles(words: list[str], n: int = 5) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def is_copy(prompt: str, response: str, least: float = 0.8) -> bool:
    """True if the response says nothing but the prompt, once or several times over.

    Shingles of five words of the response must be contained in the (repeated) prompt, or the
    longest common subsequence cover the response; and it must cover the better part of the prompt.
    """
    said = set(response.lower().split())
    if len(said & set(prompt.lower().split())) < 0.4 * len(said):  # before the costlier tokens
        return False
    a, b = tokens(prompt), tokens(response)
    if len(a) < 3 or len(b) < 3:
        return False
    a = a * max(1, round(len(b) / len(a)))
    if len(b) > 1.35 * len(a) + 4:
        return False
    if len(set(b) & set(a)) < 0.7 * len(set(b)):
        return False
    sa, sb = shingles(a), shingles(b)
    contained = len(sb & sa) / len(sb)
    common = lcs_length(a, b)
    return (contained >= least or common >= 0.85 * len(b)) and common >= 0.6 * len(a)


_VISIBLE = re.compile(r"\w", re.U)
_LIST_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")


def is_empty(response: str | None) -> bool:
    """No letter, digit or code anywhere."""
    return response is None or not _VISIBLE.search(response)


_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_GOES_ON = re.compile(r"[-+*/%=,.&|<(\[{\\]$|\b(?:and|or|not|in|is)$")


def breaks_off(code: str) -> bool:
    """True if code ends on an operator or opening bracket with brackets still open."""
    code = _LITERAL.sub("''", code).rstrip()
    still_open = sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")
    return still_open > 0 and _GOES_ON.search(code) is not None


def is_truncated(response: str) -> bool:
    """True if the text stops inside a sentence, an open code block, or the code of a closed one.

    Lists, headings before code, code alone and code marks are complete without a full stop; inline
    code at the end of running text is a part of its sentence.
    """
    fence = None
    if "```" in response or "~~~" in response:
        for line in response.split("\n"):
            line = line.lstrip()
            if line.startswith(("```", "~~~")):
                mark = line[:3]
                if fence is not None:
                    fence = None
                elif line.count(mark) == 1:  # else opened and closed on one line
                    fence = mark
    if fence is not None:
        return True
    text = response.rstrip()
    if text.endswith("…") or text.endswith("...") and not text.endswith("...."):
        return True
    if text.endswith(("```", "~~~")):
        return breaks_off(re.split("```|~~~", text)[-2])
    if text.endswith("[code block]"):
        return False
    last = text[text.rfind("\n") + 1 :]
    if _LIST_ITEM.match(last):
        return False
    if text.count("`") % 2 and "```" not in text:
        return True
    if text.endswith("`") and not _WORD.search(_INLINE.sub(" ", last)):  # inline code alone
        return False
    if last.rstrip("'\")]*_”’»`").endswith((".", "!", "?", "。")):
        return False
    if last.endswith((",", ";", "(", "[", "{", "–", "—", "-", ":", "=", "+")):
        return True
    if last.endswith((")", "]", "}", ">")):  # a complete line of code
        return False
    return len(_WORD.findall(last)) >= 2


def wrong_language(prompt: str, response: str) -> bool:
    """True if the answer is clearly in a language that the question is neither in nor asks for."""
    if _ASKED.search(prompt):
        return False
    answered = language_votes(response)
    told = clear_language(answered, least=2.5, share=0.6)
    if told is None:
        return False
    asked = language_votes(prompt)
    spoken = clear_language(asked, least=1.5, share=0.55)
    return spoken is not None and spoken != told and asked.get(told, 0) < 0.3 * sum(asked.values())


def defect(prompt: str | None, response: str | None) -> str | None:
    """The defect of a pair, or None.  An empty prompt can neither be copied nor set a language."""
    if is_empty(response):
        return "empty"
    asked = prompt or ""
    if asked and is_copy(asked, response):
        return "copy"
    if is_refusal(response):
        return "refusal"
    if is_truncated(response):
        return "truncated"
    if asked and wrong_language(asked, response):
        return "wrong_language"
    return None


@F.pandas_udf(T.StringType())
def defect_of(prompts: pd.Series, responses: pd.Series) -> pd.Series:
    return pd.Series([defect(p, r) for p, r in zip(prompts, responses)], dtype=object)


def find_defects(turns: DataFrame) -> DataFrame:
    """(transcript_id, turn_idx, defect) of every defective pair, distinct.

    Defined results: a null or blank answer is ``empty``; a null question has no language and
    nothing to copy; the first fitting of empty, copy, refusal, truncated, wrong_language is given.
    """
    pairs = prompt_response_pairs(turns)
    found = pairs.select("transcript_id", "turn_idx", F.explode(F.array(defect_of("prompt", "response"))).alias("defect"))
    return found.where("defect IS NOT NULL").distinct()
