"""Credentials embedded in text and source code (problem 1).

Each detection rule is one regular expression whose group ``s`` is the credential.  The trigram index
finds the turns that can match any rule; the rules run only there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from turnwise.llm.trigrams import TrigramQuery, required_strings

_NAME = r"(?:password|passwd|passphrase|passcode|passwort|kennwort|contrase[nñ]a|secret|token|api[_-]?key|access[_-]?key|signing[_-]?key|service[_-]?key|secret[_-]?key|account[_-]?key|private[_-]?key|auth[_-]?key|pwd|[_.-]pass|[_.-]pw)"
#: What may follow the name in its own identifier or markup before the value starts.
_TO = r"(?:[\"'`]?\]?\s*(?::\s*(?:str|string)\s*)?(?:=>|:=|=|:)\s*)"

#: Names of variables in lines of an environment, and the value that makes up the rest of the line.
_ENV_NAME = r"(?:PASSWORD|PASSWD|PASSPHRASE|PASSCODE|PASSWORT|KENNWORT|SECRET|TOKEN|API_?KEY|ACCESS_?KEY|SIGNING_?KEY|SERVICE_?KEY|SECRET_?KEY|ACCOUNT_?KEY|PRIVATE_?KEY|AUTH_?KEY|PWD|_PASS|_PW)"
_LINE_VALUE = r"(?P<s>[^\s\"'`,;<>()\[\]{}0-9]{8,})[ \t\r]*$"

#: Fixed shapes of issued tokens, recognised without any context.
RULES: dict[str, str] = {
    "access_key_id": r"(?<![A-Za-z0-9])(?P<s>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])",
    "code_host_token": r"(?<![A-Za-z0-9])(?P<s>(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{16,})",
    "service_token": r"(?<![A-Za-z0-9])(?P<s>(?:sk_live_|sk_test_|pk_live_|pk_test_|rk_live_)[A-Za-z0-9]{16,}|(?:xoxb-|xoxp-|xoxa-|xoxr-)[A-Za-z0-9-]{16,})",
    "model_key": r"(?<![A-Za-z0-9-])(?:key|token|ecret|=|:|\"|'|`|\s|\()(?P<s>sk-(?=[A-Za-z0-9_-]*[0-9])[A-Za-z0-9_-]{32,})",
    "signed_token": r"(?<![A-Za-z0-9])(?P<s>eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
    "private_key": r"(?s)(?P<s>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----.+?-----END (?:[A-Z]+ )*PRIVATE KEY-----)",
    "quoted_assignment": r"(?i)" + _NAME + _TO + r"(?P<q>[\"'`])(?P<s>[^\"'`\s]+)(?P=q)",
    "bare_assignment": r"(?im)" + _NAME + r"(?:=|:[ \t]+|[ \t]+=[ \t]+|[ \t]+(?=[^\s:=]+[ \t]*$))(?P<s>(?=[^\s\"'`]*[0-9])[^\s\"'`,;<>()\[\]{}]+)(?=$|[\s;,\"'`<&])",
    "env_line": r"(?m)^[ \t]*(?:(?:export|set|ENV|ARG|-e|-)[ \t]+)?[A-Z0-9_]*" + _ENV_NAME + "=" + _LINE_VALUE,
    "ini_line": r"(?im)^[ \t]*(?:export[ \t]+)?[a-z0-9_.-]*" + _NAME + r"[ \t]*=[ \t]*" + _LINE_VALUE,
    "default_value": r"(?i)(?:getenv|environ\.get|env\.get|env)\(\s*[\"'][^\"']*" + _NAME + r"[\"']\s*,\s*[\"'](?P<s>[^\"'\s]+)[\"']",
    "markup": r"(?i)<(?:[a-z0-9]+[_.:-])*(?:password|passwd|passphrase|passcode|secret|token|api-?key|pwd|pass|pw)>(?P<s>[^<>\s]+)</",
    "authorization": r"(?i)(?:bearer|authorization[\"']?\s*[:=]\s*[\"']?(?:basic|token|bearer))\s+(?P<s>[A-Za-z0-9+/=._~-]{8,})",
    "url_login": r"(?i)[a-z][a-z0-9+.-]*://[^\s:/@\"']*:(?P<s>[^\s@/\"']+)@",
    "command_login": r"(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[ =]?[\"']?[^\s:\"']+:(?P<s>[^\s\"']+)",
    "netrc": r"(?i)\blogin\s+\S+\s+password\s+(?P<s>\S+)",
    "login_call": r"(?i)(?:login|authenticate|connect|sign_?in|auth)\(\s*[\"'][^\"'\n]+[\"']\s*,\s*[\"'](?P<s>[^\"'\s]+)[\"']",
    "login_tuple": r"(?i)\(\s*[\"'][a-z0-9]+(?:_[a-z0-9]+)*(?:_rw|_ro|_svc|_app|_admin|_user)[\"']\s*,\s*[\"'](?P<s>[^\"'\s]+)[\"']\s*\)",
    "sql_login": r"(?i)(?:identified\s+by|password)\s+[\"'](?P<s>[^\"'\s]+)[\"']",
    "told_token": r"(?i)(?:token|api key|access key|secret key|secret|key)\s+is\s+(?P<s>(?=\S*[0-9])[A-Za-z0-9+/=._~-]{16,})",
    "told_pasted": r"(?i)\bpasted\s+(?P<s>(?=\S*[0-9])[A-Za-z0-9+/=._~-]{16,})\s+into\b",
    "told_password": r"(?i)(?:(?:(?:password|passphrase|passcode|passwd|pwd|kennwort|passwort|contraseña|mot de passe|clave)\b| pw )[^.\n:=]{0,60}?\s(?:is|lautet|ist|est|es)\s+)(?P<s>(?=\S*[0-9])\S{6,})",
    "told_login": r"(?i)\blogin\s+\S+\s+/\s+(?P<s>(?=\S*[0-9])\S{6,})",
}

#: Words that stand for a credential without being one.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:change[_-]?me|replace[_-]?(?:me|this)?|your[_-].*|(?:.*[_-])?here|(?:your|my|put|add|paste|the)\w*here|x{3,}|\*{3,}|\.{2,}|-+|<.*>|todo|tbd|none|null|nil|undefined|true|false|example|sample|dummy|test|\[?redacted.*|placeholder|insert.*|enter.*|fill[_-].*|str|string|int|bool|bytes|optional|any|password|passwd|secret|token|passphrase)$"
)
_REFERENCE = re.compile(r"[$<>{}\[\]()]|^%|%$|^env[.:]|^vault[.:/]|^secret[s]?[/:]|os\.|process\.|environ")
_PATHLIKE = re.compile(r"^(?:\.{0,2}/)?(?:[A-Za-z_.-]+/)+[A-Za-z_.-]+$")
_TRAILING = ".,;:"
#: Words in a value without digits that tell it from a credential.
_SPOKEN_OF = re.compile(r"(?i)your|example|sample|dummy|placeholder|replace|change|insert|value|generated|from|token|secret|passw|passphrase|key|redacted|credential")
_HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _is_plain_secret(value: str, rule: str) -> bool:
    """Whether a value without digits, the rest of a ``NAME=value`` line, is a literal and no identifier or reference.

    In lines of an environment a value of mixed case, or a long one of letters alone or that is no identifier, is a literal;
    in other lines, which may be code, only one whose capitals fall as by chance.
    """
    if _SPOKEN_OF.search(value) or re.fullmatch(r"(?:[A-Za-z_]\w*(?:\.|->|::))+[A-Za-z_]\w*", value):
        return False
    mixed = value.upper() != value != value.lower()
    if rule == "env_line":
        return mixed or len(value) >= 16 and (value.isalpha() or not value.isidentifier())
    humps = _HUMP.findall(value)
    return mixed and len(value) >= 16 and sum(map(len, humps)) < 3 * len(humps)


def is_credential(value: str, rule: str) -> bool:
    """Rules out placeholders, references to variables, environment or vaults, and paths."""
    if rule == "private_key":
        return True
    if len(value) < 4 or _PLACEHOLDER.match(value) or len(set(value)) <= 2:
        return False
    if rule in ("access_key_id", "code_host_token", "service_token", "model_key", "signed_token"):
        return True
    if value.startswith("-----") or _PATHLIKE.match(value):
        return False
    if rule != "url_login" and value.startswith(("http://", "https://", "data:", "sha256", "sha512", "arn:")):
        return False
    if re.search(r"^[$%][A-Za-z_{(]|\$\{|\{\{|^\{.*\}$|^<|\(\)|\w\(", value):
        return False
    if rule in ("bare_assignment", "env_line", "ini_line", "url_login", "command_login") and _REFERENCE.search(value.rstrip("$")):
        return False
    if rule == "bare_assignment" and re.fullmatch(r"[\d.]+|(?:[A-Za-z_]\w*\.)+[A-Za-z_]\w*", value):
        return False
    return rule not in ("env_line", "ini_line") or _is_plain_secret(value, rule)


#: Rules that ignore case run over the lower-case text without the flag, which lets the engine skip by first letters.
_FOLDED = re.compile(r"^\(\?([a-z]*)i([a-z]*)\)")


def _compiled(pattern: str) -> tuple[bool, re.Pattern]:
    m = _FOLDED.match(pattern)
    if not m:
        return False, re.compile(pattern)
    flags = "".join(m.groups())
    return True, re.compile((f"(?{flags})" if flags else "") + pattern[m.end() :])


QUERY = TrigramQuery.of(RULES)
_COMPILED = {k: (*_compiled(v), min(required_strings(v), key=len)) for k, v in RULES.items()}


def find_secrets(text: str | None, rules: int = -1) -> list[tuple[int, int, str]]:
    """(start, end, rule) of each credential of a text; nothing overlaps, an earlier rule has precedence.

    ``rules`` is the bitmap of the rules that can match, as the trigram index tells it.
    """
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift the positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts: list[int] = []  # of what is taken, in order
    taken: dict[int, tuple[int, str]] = {}
    for n, (rule, (folded, pattern, needs)) in enumerate(_COMPILED.items()):
        if not rules >> n & 1 or len(needs) <= 12 and not any(s in low for s in needs):
            continue
        for m in pattern.finditer(low if folded else text):
            a, b = m.span("s")
            if rule.startswith("told_") or rule in ("netrc", "bare_assignment", "command_login"):
                while b > a and text[b - 1] in _TRAILING:
                    b -= 1
            at = bisect_left(starts, a)
            free = (at == 0 or taken[starts[at - 1]][0] <= a) and (at == len(starts) or b <= starts[at])
            if free and is_credential(text[a:b], rule):
                starts.insert(at, a)
                taken[a] = (b, rule)
    return [(a, *taken[a]) for a in starts]


def redact(text: str | None, placeholder: str = "REDACTED_CREDENTIAL") -> str | None:
    """The text with each credential replaced; quotes, names and line structure around it stay as they are."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in find_secrets(text):
        out += [text[at:a], placeholder]
        at = b
    return "".join([*out, text[at:]])


def _all_of(texts: Iterable[str | None], rules: int = -1) -> list[str]:
    return sorted({t[a:b] for t in texts if t for a, b, _ in find_secrets(t, rules)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def secrets_of(texts: pd.Series, rules: pd.Series) -> pd.Series:
    return pd.Series([_all_of(a, int(r)) if a is not None else [] for a, r in zip(texts, rules)], dtype=object)


def turn_chunks(turns: DataFrame) -> DataFrame:
    """(transcript_id, turn_idx, chunks): the content and the code blocks of each turn."""
    return turns.select("transcript_id", "turn_idx", F.filter(F.concat(F.array("content"), F.coalesce(F.col("code_blocks.code"), F.array().cast("array<string>"))), lambda x: x.isNotNull()).alias("chunks"))


def trigram_index(chunks: DataFrame) -> DataFrame:
    """Adds ``postings``, the bitmap of required trigrams in the row's chunks."""
    return chunks.withColumn("postings", QUERY.index("array_join(chunks, '\\n')"))


def find_credentials(turns: DataFrame) -> DataFrame:
    """(transcript_id, turn_idx, secret_text), distinct.

    One scan, no shuffle but for the small result.  Null or empty content and blocks hold nothing; a
    row delivered several times counts once; texts are read whole.
    """
    indexed = trigram_index(turn_chunks(turns))
    # Not a filter: it would be pushed down with a second copy of the index.
    met = F.filter(F.array(QUERY.rules("postings")), lambda r: r != 0)
    candidates = indexed.select("transcript_id", "turn_idx", "chunks", F.explode(met).alias("rules"))
    found = candidates.select("transcript_id", "turn_idx", F.explode_outer(secrets_of("chunks", "rules")).alias("secret_text"))
    return found.where("secret_text IS NOT NULL").distinct()


def redact_turns(turns: DataFrame, placeholder: str = "REDACTED_CREDENTIAL") -> DataFrame:
    """The turns with content and code blocks redacted; rows that are no candidates pass unchanged and never reach Python."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda a: [redact(t, placeholder) for t in a])

    text = F.concat(F.array("content"), F.coalesce(F.col("code_blocks.code"), F.array().cast("array<string>")))
    x = turns.withColumn("_t", text).withColumn("_p", QUERY.index("array_join(_t, '\\n')"))
    marked = x.withColumn("_hit", QUERY.rules("_p") != 0).drop("_p")
    clean_part = marked.where("NOT _hit").drop("_t", "_hit")
    hit = marked.where("_hit").withColumn("_n", clean("_t"))
    blocks = F.when(F.col("code_blocks").isNotNull(), F.transform("code_blocks", lambda b, i: b.withField("code", F.get("_n", i + 1))))
    hit = hit.withColumns({"content": F.element_at("_n", 1), "code_blocks": blocks}).drop("_t", "_hit", "_n")
    return clean_part.unionByName(hit)
