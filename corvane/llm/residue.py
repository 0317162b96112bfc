"""Problem 4: pages with unfilled slots, filler text, or nothing but an error or script notice.

Normalised lines are counted by host over all documents; lines that recur on the host are taken off, and so are lines that the
tagger of ``blocks`` calls no content (a host of one page has no recurrent lines); what is left of the page is its residual.
A page whose residual is evidence of an error, a block, a default page or a script notice, with next to no other text, is a
message. Slots, empty values and instructions count wherever they stand, filler by the share of filler words in a sentence: a
line that is evidence itself is never taken off, however often it recurs. Only lines of pages that hold evidence of a message
are counted, since no other page's verdict depends on counts; that is a semi-join and changes no result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.urls import site_of
from corvane.llm.blocks import INVISIBLE, SPACE, Tagger
from corvane.llm.repeated_lines import line_key
from corvane.runtime import materialize, small_or_none, spread

#: Documents of a host from which on a line counts as recurrent.
RECURRENT = 3
#: Words of real text beside a message up to which a page still is only that message.
REST_WORDS = 30

_NAME = r"\s*[A-Za-z][\w.\- ]{0,30}?\s*"
#: The ways templates mark a slot.
SLOTS = [
    rf"\{{\{{{_NAME}\}}\}}", rf"\{{%{_NAME}%\}}", rf"<<{_NAME}>>", rf"\[\[{_NAME}\]\]", rf"\*\|{_NAME}\|\*", r"%%\w[\w.\-]*%%", r"@@\w[\w.\-]*@@",
    r"(?<!\w)__[A-Za-z][\w.\-]*?__(?!\w)", rf"\$\{{{_NAME}\}}", r"(?<![\w#])#[A-Za-z][A-Za-z_.\-]*#(?!\w)", r"(?<![{$\w])\{[A-Za-z][\w.\-]*\}(?!\})",
    r"(?<![<\w])<[A-Za-z][\w.\-]*(?: [A-Za-z]+)?>(?!>)", r"(?<![%\w])%[A-Z][A-Z_]+%(?!\w)",
]
SLOT = re.compile("|".join(SLOTS))
#: Names that a slot in single square brackets usually has.
BRACKET = re.compile(
    r"(?i)\[\s*(?:(?:insert|add|enter|your|page|first|last|company|product|customer|client|business|link|site|street|post|phone|e-?mail)[ _.\-]*)?"
    r"(?:name|title|city|town|price|service|owner|phone|date|rating|text|link|address|company|product|time|year|month|number|amount|url|image|photo|here|location|state|country|headline|caption|paragraph)"
    r"(?:[ _.\-]*(?:here|name|text))?\s*\]"
)
#: Marks of a page that writes about slots and filler instead of having them.
ABOUT = re.compile(r"(?i)\b(?:write|type|put|enter|use|paste|tag|token|syntax|called|variable|escibe|escriba|écrivez|schreiben sie|tippen sie)\s+[\"'“«`]?$")
EMPTY = re.compile(
    r"\bnull null\b|\bundefined undefined\b|\b(?:for|from|by|to|at|since|is|of|in|dear|serve|served|led by|call|costs?) (?:null|undefined|NaN|None|\[object Object\]|nil)\b|\[object Object\]"
    r"|\bNaN (?:years|percent|euros?|credits|hours|%)|\b(?:null|undefined|NaN) (?:homes|years|percent|euros?|credits|hours|customers|reviews|jobs)\b|\bXXX+ (?:years|hours|percent|jobs|homes)\b|\bX{4,}\b|\btrusted by NAME\b|\b(?:COMPANY|CITY|SERVICE|FIRST|PRODUCT)_?NAME\b"
)
INSTRUCTION = re.compile(
    r"(?i)\b(?:TODO|FIXME|TBC|TBD)\b\s*[:\-–]|\((?:add|insert|replace|put|write|describe)\b[^)]{2,60}\)|\[(?:add|insert|replace|put|write|describe|todo|tbd|tbc)\b[^\]]{2,60}\]"
    r"|^\s*click here to edit\b|\byour (?:text|headline|title|company|name|content|slogan|tagline|copy) (?:goes )?here\b|^\s*(?:insert|replace this|add your|enter your|describe your|write your)\b[^.]{0,60}\b(?:here|text|copy|content|name)\b"
    r"|\bcopy (?:to follow|to come)\b|\bcopy for .{2,60} to follow\b|^\s*(?:placeholder (?:paragraph|text|copy)|sample text|dummy text|body copy to come)\s*(?:[.:!]|$)|^\s*lorem ipsum\b"
    r"|\bhier (?:steht ihr text|text einfügen)\b|\bvotre texte ici\b|\bsu texto aquí\b|\bここに(?:テキスト|文章)"
)
#: Words of filler text.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
DUMMY = set(
    "arrive blind block body caption client content copy dummy final follow from goes greeking headline here intro more placeholder please real sample subhead supply "
    "teaser text the to until wording words your come paragraph".split()
)
_SURE = {"dummy", "greeking", "subhead", "wording", "headline", "caption", "teaser", "placeholder", "copy", "blind", "intro", "sample"}
#: What programs, servers and gates say in place of a page, by what is said and not by whole sentences.
EVIDENCE = {
    "status": r"\b(?:http(?:/\d(?:\.\d)?)?|error|status|code|fehler|erreur)[ :#-]{0,3}(?:code[ :]{0,2})?\d{3,4}\b|^\W*[45]\d\d\b\W*(?:[^\W\d_]+\W*){0,5}$",
    "missing": r"\bnot (?:be )?found\b|\bnot on this server\b|\bno longer (?:exists?|available|here)\b|\b(?:page|address|file|site) (?:is|was|has been|may have) (?:gone|moved|removed|deleted)|\bmay have moved\b|\blooked everywhere\b|\bpage you (?:asked|requested|are looking|were looking)"
    r"|\bcheck the (?:address|url|spelling)\b|nicht gefunden|introuvable|no (?:se )?(?:ha )?(?:encontrad|existe)|n'existe (?:pas|plus)|existiert nicht|page demandée|angeforderte seite|dirección solicitada|見つかりません|お探しのページ|移動または削除",
    "failure": r"\b(?:internal|server|fatal|parse|syntax|database|connection|application|unknown|unexpected|runtime) (?:\w+ )?(?:error|fault|failure)\b|\berror (?:establishing|connecting|while|occurred)|\b(?:an?|unknown) error\b|\bexception\b|\btraceback\b|\bstack trace\b|\bon line \d+|\bwarning: \w+|\bupstream\b|\bbad (?:gateway|request)\b"
    r"|\btimed? ?-?out\b|\bcould(?: not|n't) (?:be )?(?:connect|establish|load|display|process|complet|open|reach)|\b(?:un|not )available\b|\bwent wrong\b|^\W*oops\b|\b(?:please )?(?:try again|reload|refresh) (?:the page|later|in)\b|\bplease reload\b|\bour team has been told\b|erreur interne|error interno|interner serverfehler|サーバーエラー|内部エラー|réessay|erneut versuchen|inténtelo de nuevo|vuelva a intentar|再度お試し|\bsql(?:state)?\b|\breference #|\b(?:request|ray|incident|trace) id\b",
    "closed": r"\bdown for\b|\b(?:under|for) (?:maintenance|construction)\b|\bmaintenance mode\b|\bwill be back\b|\bcoming soon\b|\bcheck back\b|\bbuilding something new\b|\bdomain (?:\S+ )?(?:is|may be|has|name) ?(?:parked|for sale|expired|been)?|\bbuy this domain\b|\b(?:account|site|website|domain) (?:has been|is|was) (?:suspended|disabled|parked|closed)|\bcontact your (?:provider|host|administrator)"
    r"|en mantenimiento|en maintenance|wartungsarbeiten|メンテナンス|bientôt (?:disponible|en ligne)|próximamente|im aufbau|準備中|\bdefault (?:web ?)?page\b|\btest page\b|^\W*it works\W*$|\bwelcome to (?:nginx|apache|iis|caddy)|^\W*index of /|^\W*parent directory\W*$",
    "gate": r"\baccess (?:is |was )?(?:denied|blocked|restricted)|\bforbidden\b|\bpermission to\b|\bdo not have permission|\bnot authori[sz]ed|\bunauthori[sz]ed\b|zugriff verweigert|acceso denegado|accès (?:refusé|interdit)|アクセスが拒否|\b(?:log|sign) ?in (?:again|to (?:see|view|continue|read|access))|bitte melden sie sich|\bsession (?:has )?(?:expired|timed)|sitzung abgelaufen|session expirée|sesión (?:ha )?(?:caducado|expirado)"
    r"|\btoo many requests\b|\bslow down\b|\brate limit|\bunusual traffic\b|\bcaptcha\b|\b(?:you are|are you) (?:not )?(?:a )?(?:robot|human)|\bnot a robot\b|\btick the box\b|\bsolve the\b|\bchecking (?:your|the) (?:browser|connection)|\b(?:this )?takes a few seconds\b|\bverif(?:y|ying) (?:that )?you\b|\bsecurity (?:service|check)\b|\bonline attacks\b|\bone more step\b|\battention required\b|\bddos\b|ロボットではない",
    "scripts": r"(?:enabl|activ|aktivier|habilit|turn(?:ed)?\b|allow|switch|requir|need|disabled|deactivat|désactivé|deaktiviert|without|erforderlich|nécessaire|necesit)\w*[^.!?]{0,40}\b(?:java ?scripts?|scripts?|scripting)\b|\b(?:java ?scripts?|scripts?|scripting)\b[^.!?]{0,40}(?:enabl|activ|aktivier|habilit|turn|allow|requir|need|disabled|désactivé|deaktiviert|erforderlich|nécessaire|necesari|\bon\b|\boff\b|not supported)"
    r"|javascript\s*(?:を|が)|scriptを|^\W*noscript\b|\bbrowser is (?:out of date|not supported|too old)|^\W*(?:loading|laden|chargement|cargando|読み込み中)\W*$|\bif nothing happens\b",
}
#: Small-letter substrings of which every line with such evidence has one (or it begins with a status number).
TRIGGERS = {
    "status": "http|error|status|code|fehler|erreur",
    "missing": "not found|not be found|not on this server|no longer|gone|moved|removed|deleted|looked everywhere|page you|check the|nicht gefunden|introuvable|encontrad|existe|existiert|page demandée|angeforderte|solicitada|見つかりません|お探し|移動または",
    "failure": "error|internal|server|fatal|parse|syntax|database|connection|application|unknown|unexpected|runtime|exception|traceback|stack trace|on line|warning:|upstream|bad gateway|bad request|time-out|timeout|timed|time out|could|available|went wrong|oops|try again|reload|refresh"
    "|our team|interne|interno|サーバーエラー|内部エラー|réessay|erneut|de nuevo|vuelva a|再度お試し|sql|reference #|request id|ray id|incident id|trace id",
    "closed": "down for|maintenance|construction|will be back|coming soon|check back|building something|domain|account|website|suspended|disabled|contact your|mantenimiento|wartungsarbeiten|メンテナンス|bientôt|próximamente|im aufbau|準備中|default page|default web|test page|it works|welcome to|index of|parent directory|parked|closed",
    "gate": "access |forbidden|permission|authori|zugriff|acceso|accès|アクセス|log in|login|sign in|signin|melden sie|session|sitzung|sesión|too many|slow down|rate limit|unusual traffic|captcha|robot|human|tick the box|solve the|checking |takes a few|verif|security |online attacks|one more step|attention required|ddos|ロボット",
    "scripts": "script|browser is|loading|laden|chargement|cargando|読み込み中|if nothing",
}
TRIGGERS = {k: tuple(v.split("|")) for k, v in TRIGGERS.items()}
_KINDS = {k: re.compile(v) for k, v in EVIDENCE.items()}
_NUMBER = re.compile(r"(?m)^\W{0,8}[45]\d\d\b")
#: Characters up to which a line can be a message; a longer one is text, whatever it says.
MESSAGE_CHARS = 160
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[぀-ヿ一-鿿]")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n")
#: Substrings without which no slot, empty value or instruction can be in a text (of the text, and of its lower case).
_SIGNS = ("{", "<", "#", "%", "@@", "*|", "__", "[", "null", "undefined", "NaN", "None", "nil", "XXX", "NAME")
_LOW_SIGNS = (
    "todo", "fixme", "tbc", "tbd", "(add", "(insert", "(replace", "(put", "(write", "(describe", "click here to edit", "your text", "your headline", "your title", "your company", "your name", "your content",
    "your slogan", "your tagline", "your copy", "insert ", "replace this", "add your", "enter your", "describe your", "write your", "copy to ", "copy for ", "placeholder", "sample text", "dummy text", "body copy",
    "lorem ipsum", "hier steht ihr", "text einfügen", "votre texte", "su texto", "ここに",
)
#: Words of which every filler sentence has one.
_FILLER_SIGNS = ("dummy", "greeking", "subhead", "wording", "headline", "caption", "teaser", "dolor", "amet", "lorem", "elit", "nisi", "laboris", "veniam", "aute", "magna", "commodo", "esse", "placeholder", "intro", "sample", "blind")
_QUICK = re.compile(r"[{}<>\[\]#%@*_]|(?i:null|nan\b|undefined|none|nil\b|object|todo|tbc|tbd|fixme|xxx|edit|insert|here|copy|name|placeholder|sample|dummy|lorem|replace|ここ|hier|aqu)")


def has_slot(s: str) -> bool:
    """Whether a sentence holds a slot, an empty value or an instruction to the author."""
    if not _QUICK.search(s):
        return False
    for rx in (SLOT, BRACKET):
        for m in rx.finditer(s):
            if not ABOUT.search(s[: m.start()]):
                return True
    return bool(EMPTY.search(s) or INSTRUCTION.search(s))


def is_filler(s: str) -> bool:
    """Whether most words of a sentence are filler words."""
    w = [x.lower() for x in _WORD.findall(s)]
    if len(w) < 5:
        return False
    if sum(x in LATIN for x in w) >= max(4, 0.6 * len(w)):
        return len({x for x in w if x in LATIN and len(x) > 3}) >= 2
    return sum(x in DUMMY for x in w) >= 0.85 * len(w) and sum(x in _SURE for x in w) >= 2


def message_line(line: str, kinds=tuple(EVIDENCE)) -> bool:
    """Whether a line says what only a program, a server or a gate says in place of a page."""
    if len(line) > MESSAGE_CHARS:
        return False
    low = line.lower()
    return any((any(x in low for x in TRIGGERS[k]) or k == "status") and _KINDS[k].search(low) for k in kinds)


def _words(line: str) -> int:
    return len(_WORD.findall(line)) + len(_CJK.findall(line)) // 3


def evidence(text: str, title: str, tagger: Tagger) -> tuple[str | None, list[tuple[str, int]]]:
    """slot, filler, message or None; for a message also the other lines of content as (key, words), to be weighed without recurrent ones."""
    text, title = INVISIBLE.sub("", text), INVISIBLE.sub("", title)
    if not text.strip():
        return None, []
    if has_slot(SPACE.sub(" ", title)):
        return "slot", []
    low = text.lower()
    slots = any(x in text for x in _SIGNS) or any(x in low for x in _LOW_SIGNS)
    filler = sum(x in low for x in _FILLER_SIGNS) >= 2
    lines = text.split("\n")
    if slots or filler:
        for raw in lines:
            line = SPACE.sub(" ", raw).strip()
            for s in _SENTENCE.split(line) if len(line) > 60 else (line,):
                if filler and is_filler(s):
                    return "filler", []
                if slots and has_slot(s) and not message_line(s):
                    return "slot", []
    flat = " ".join(low.split())
    kinds = [k for k, v in TRIGGERS.items() if any(x in flat for x in v) or k == "status" and _NUMBER.search(low)]
    if not kinds:
        return None, []
    said = [message_line(" ".join(raw.split()), kinds) for raw in lines]
    if not any(said):
        return None, []
    dropped = {k for k, s in tagger.states(text, title) if s}
    return "message", [(key_of(x), _words(x)) for k, x in enumerate(lines) if not said[k] and k not in dropped and x.strip()]


_LETTERS = re.compile(r"[\W\d_]+")


def key_of(line: str) -> str:
    """The key that ``line_key`` gives in the JVM."""
    return _LETTERS.sub("", line.lower())


def mark_of(site: str, key: str) -> int:
    """xxhash64(site, key) as the JVM computes it."""
    h = xxhash.xxh64_intdigest(key.encode(), xxhash.xxh64_intdigest(site.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def residue(docs: DataFrame, recurrent_docs: int = RECURRENT) -> DataFrame:
    """doc_id, evidence (slot, filler, message; null for a clean page): every document of the table once.

    A message is a page with a line of evidence and, recurrent lines and lines of no content aside, at most REST_WORDS other words.

    A null or empty text is clean whatever its title. A document without host has no recurrent lines. Repeated rows of a
    doc_id come out once.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(site_of(F.col("url")), F.lit("")).alias("site"), "title", "text").where("doc_id is not null")

    def search(batches):
        tagger = Tagger()
        for b in batches:
            found, rest = [], []
            for site, x, t in zip(b.column("site").to_pylist(), b.column("text").to_pylist(), b.column("title").to_pylist()):
                kind, lines = evidence(x or "", t or "", tagger)
                found.append(kind)
                rest.append([{"mark": mark_of(site, k), "words": n} for k, n in lines])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string()), pa.array(rest, pa.list_(pa.struct([("mark", pa.int64()), ("words", pa.int32())])))], names=["doc_id", "evidence", "rest"])

    seen = materialize(spread(base).mapInArrow(search, "doc_id long, evidence string, rest array<struct<mark:long,words:int>>"), "p4-seen")
    marks = F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64("site", line_key(x))))
    asked = seen.where("evidence = 'message'").select("doc_id", F.explode("rest").alias("r")).select("doc_id", "r.mark", "r.words").where("words > 0")
    asked = materialize(asked, "p4-asked")
    wanted = asked.select("mark").distinct()
    wanted = F.broadcast(wanted) if small_or_none(wanted) else wanted
    counts = base.where("site != '' and text is not null").select("doc_id", F.explode(marks).alias("mark")).join(wanted, "mark", "left_semi").groupBy("mark").agg(F.countDistinct("doc_id").alias("count"))
    full = asked.join(counts.where(F.col("count") >= recurrent_docs).select("mark"), "mark", "left_anti").groupBy("doc_id").agg(F.sum("words").alias("n")).where(F.col("n") > REST_WORDS)
    return (
        seen.select("doc_id", "evidence").join(full.select("doc_id", F.lit(True).alias("full")), "doc_id", "left")
        .withColumn("evidence", F.when((F.col("evidence") == "message") & F.col("full"), None).otherwise(F.col("evidence")))
        .groupBy("doc_id").agg(F.min("evidence").alias("evidence"))
    )
