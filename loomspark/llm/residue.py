"""Template residue, filler, error pages and script notices: a regularised linear classifier over passages.

Texts are cut into passages (sentences and lines) after what is shown rather than said is masked: code, commands, logs,
quotations, links. Features of a passage are hashed character n-grams, the kinds of unfilled slots in it, its length, and
what it is in its text (title, place, how long the text is). Labels are weak: response-status lines and a list of phrases
mark passages, and in short texts with a status line all of them. The classifier is fitted on a bounded sample, its
threshold is set on hosts (projects) that it hasn't seen, and it then judges every passage of every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import cut_lineage, spread

#: Documents whose passages may be drawn to fit the classifier, and passages without label drawn from them.
LABELLED_DOCUMENTS, UNLABELLED_PASSAGES = 15_000, 15_000
#: Hashed n-gram features, their lengths, strength of the regularisation, rounds of fitting, least threshold.
BUCKETS, ORDERS, RIDGE, EPOCHS, LEAST = 1 << 18, (3, 5, 8), 1e-6, 60, 0.5
#: Parts that hosts are dealt into so that each can be judged by the others, rounds of those fits from the start and on from
#: there, and the quantile of the
#: scores of marked passages from which one without a mark is doubtful; what the F1 of the threshold may lack.
FOLDS, FOLD_EPOCHS, MORE_EPOCHS, DOUBT, NEAR_BEST = 3, 22, 14, 0.25, 0.02
#: Passages of a text that counts as one short page.
SHORT_PAGE = 8
#: Characters that are scored at once.
CHUNK_CHARS = 1_000_000

# -- masking -----------------------------------------------------------------------------------------------------------

_FENCE = re.compile(r"^[ \t>*\-]*(```|~~~).*?(?:^[ \t>*\-]*\1[ \t]*$|\Z)", re.M | re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTE = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|«[^»\n]{1,200}»|「[^」\n]{1,200}」|『[^』\n]{1,200}』|‹[^›\n]{1,200}›|‘[^’\n]{1,200}’")
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)|!?\[[^\]\n]*\]\[[^\]\n]*\]|\[\[[^\]\n]*\]\]|^\[[^\]\n]*\]:.*$|https?://\S+", re.M)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
#: A line of underscores alone is a rule between two sections.
_BREAK = re.compile(r"^ {0,3}(?:_[ \t]*){3,}$", re.M)
#: What a server sends in place of a page, outside of code: the body of a refused request, the trace of a failed renderer.
_BODY = re.compile(r'^[ \t]*\{\s*"(?:error|errors|fault|exception)"\s*:\s*[{\["].*\}[ \t]*$', re.M)
_TRACE = re.compile(r"^Traceback \(most recent call last\):\n(?:[ \t]+.*\n)+[\w.]+(?:Error|Exception|Exit|Interrupt)\b.*$", re.M)
_SHOWN = re.compile(
    r"^[ \t]*(?:\[?\d{1,4}[-:./]\d\d[-:./]\d\d\b.*|\d{1,3}(?:\.\d{1,3}){3} .*|\$ ?(?!\d|[A-Za-z]+\$)\w+.*[-|&/].*|(?:DEBUG|INFO|WARN|WARNING|TRACE)\b.*|.*[{;]|\}.*|[\[{]\s*[\"'].*[\"'\]}:,].*|\[\s*\{\s*[\"'].*|\[(?:[\da-z_][\w.\-]*\]|\w+[.\-][\w.\-]*\]|\w+\](?=\s*\n[ \t]*[\w.\-\"]+[ \t]*[=:]))|\w+ = .*"
    r"|(?:def|class|fn|pub|export|const|let|var|import|from|return|use|for|if|set|done|while|elif|else|fi|echo|with|try|except|async|function)\b[^.!?]*[:({;$=\"'].*|-?\s*[\w\-]+:\s[^ ].*\$\{\{.*|\S+=\S+.*|[A-Z_]+ ?:?= ?.*)$",
    re.M,
)
#: A line with an operator, the operator with what it stands between, and words in a row as only sentences have them.
_OPERATED = re.compile(r"^.*(?:\s>>\s|=>|->|\)\s*:|\|\||&&).*$", re.M)
_OPERATION = re.compile(r"\S*[ \t]*(?:(?<=\s)>>(?=\s)|=>|->|\)\s*:|\|\||&&)[ \t]*\S*")
_SAYS = re.compile(r"(?:(?<![\w.$/\-])[^\W\d_]{2,}[,:]? +){3}[^\W\d_]{2,}|[぀-ヿ一-鿿]{6}|[가-힯]+ [가-힯]+ [가-힯]+")
_TAG = re.compile(r"</?(?:h[1-6]|p|b|i|em|strong|hr|br|title|body|head|html|div|span|center|pre|a|ul|ol|li|section|main|header|footer|noscript)\b[^>\n]*>", re.I)

#: Kinds of unfilled slots. Words are fixed values: what asks to fill something in, in the languages of the corpus.
_ASK = (
    r"your|insert|enter|add|fill in|here|goes here|tbd|to be (?:added|filled|completed|defined)|einfügen|eintragen|ergänzen|angeben|hier|escriba|añadir|añada|inserte|aquí|indicar|nombre|insérer|renseigner|compléter|saisir|ici|inserir|preencher|inserir|aqui|nome"
    r"|вставьте|вставить|укажите|указать|впишите|введите|добавить|имя|описание|дата|descrição|descripción|Beschreibung|title|titre|título|название|ここに|入力|記入|追加|填写|请输入|输入|插入|此处|名称|입력|기입|여기에|이름|추가"
)
_SLOTS = (
    re.compile(r"\{\{+[^{}\n]{0,40}\}\}+|\{\{+[^{}\n]{1,40}\|[^{}\n]{1,40}\}\}"),
    re.compile(r"<%[=\-]?[^%\n]{1,40}%>|\{%[^%\n]{1,40}%\}"),
    re.compile(r"[$#]\{[A-Za-z_][\w.\- ]{0,40}\}"),
    re.compile(r"%[A-Z][A-Z_]{2,40}%|@@[A-Z_]{2,40}@@|\bXX_[A-Z_]{2,40}_XX\b|\bX_[A-Z_]{2,40}_XX\b|__[A-Z][A-Z_]{2,40}__|\$[A-Z][A-Za-z]{2,40}\$"),
    re.compile(r"(?<!\w)%[sd](?!\w)|\{\d\}"),
    re.compile(r"(?<![\w$#{])\{[a-z][a-z_]{2,40}\}"),
    re.compile(rf"\[(?=[^\]\n]*(?:\s|[^\x00-\x7f]))[^\]\n]*(?:{_ASK})[^\]\n]*\](?![(\[:])", re.I),
    re.compile(rf"<(?=[^<>\n]*(?:\s|[^\x00-\x7f]))(?![/!|])[^<>|=\"/\n]*(?:{_ASK}|\bof\b|\bdel?\b|\bd[uoa]\b)[^<>|=\"/\n]*>", re.I),
    re.compile(r"<<[A-Za-z][A-Za-z _]{1,40}>>|<[A-Z][A-Z_]{2,40}>|&&[A-Za-z_]{2,40}&&"),
    re.compile(r"_{5,}|［[^］\n]{2,40}］|[【＜][^】＞\n]*(?:名|入力|記入|填写|输入|日期|摘要|标题|입력|이름)[^】＞\n]*[】＞]|\$\([A-Z][A-Z_]+\)"),
    re.compile(r"\[(?!(?:Insert|Esc|Enter|Tab|Ctrl|Alt|Shift|Del|Delete|Home|End|Space|Return|Backspace|Unreleased|Note|Draft|Added|Changed|Fixed|Removed|Deprecated|Security)\])[A-Z][a-z]+(?:[A-Z][a-z]+)*\](?![(\[:])"),
    re.compile(r"\([^()\n]{2,40} (?:goes here|to be added|to follow)\)", re.I),
)
#: Slots that nothing else looks like, by kind, with what they hold: marked before the lines that only show something go.
_EARLY = (
    (0, ("{{",), re.compile(rf"(?<!\$)(?:{_SLOTS[0].pattern})")),
    (3, ("%", "@@", "XX_"), re.compile(r"%[A-Z][A-Z_]{2,40}%|@@[A-Z_]{2,40}@@|\bXX_[A-Z_]{2,40}_XX\b")),
    (8, ("&&",), re.compile(r"&&[A-Za-z_]{2,40}&&")),
)
_SENT, _TRACED = len(_SLOTS), len(_SLOTS) + 1
_KINDS = _TRACED + 1
_SLOT0, _CODE, _SAID, _LINKED = 0xE010, "\ue000", "\ue001", "\ue002"
_EARLY_SLOT = re.compile("[" + "".join(chr(_SLOT0 + k) for k, _, _ in _EARLY) + "]")
_ERROR_TITLE = re.compile(r"\b[45]\d\d\b.*\b(?:not found|forbidden|unauthorized|unavailable|gateway|server error|bad request)\b", re.I)
_DECOR = re.compile(r"^[ \t>]*(?:[-*+•] |\d+[.)] )?[ \t]*", re.M)
_HEAD = re.compile(r"^(?:#{1,6}|=+)[ \t]+", re.M)
_HEADED = "\ue003"
_CUT = re.compile(r"[.!?…。！？\n\t|/](?:(?<=[。！？\n\t])|(?<=[.!?…])[\"”’)]*(?=\s)|(?<=\s[|/])(?=\s))")


def _without_operations(line: re.Match) -> str:
    """A line without its operators and what they stand between; nothing of it if no sentence is left."""
    rest = _OPERATION.sub(_CODE, line.group())
    return rest if _SAYS.search(rest) or _ERROR_TITLE.search(rest) or _EARLY_SLOT.search(rest) else ""


def mask(text: str) -> str:
    """A text with what it only shows taken out and its slots marked by kind."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "<!--" in text:
        text = _COMMENT.sub("", text)
    if "___" in text:
        text = _BREAK.sub("", text)
    text = _INLINE.sub(_CODE, text)
    if '{"' in text:
        text = _BODY.sub(chr(_SLOT0 + _SENT), text)
    if "Traceback" in text:
        text = _TRACE.sub(chr(_SLOT0 + _TRACED), text)
    for k, hints, slot in _EARLY:
        if any(h in text for h in hints):
            text = slot.sub(chr(_SLOT0 + k), text)
    if any(c in text for c in "{};=$>|") or _DATED.search(text):
        text = _OPERATED.sub(_without_operations, _SHOWN.sub("", text))
    text = _LINK.sub(_LINKED, text) if "](" in text or "][" in text or "[[" in text or "]:" in text or "://" in text else text
    text = _QUOTE.sub(_SAID, text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    if _SLOT_HINT.search(text):
        for k, slot in enumerate(_SLOTS):
            text = slot.sub(chr(_SLOT0 + k), text)
    text = _DECOR.sub("", text)
    return _HEAD.sub(_HEADED, text)


_DATED = re.compile(r"\d[-:./]\d\d\b|^\s*(?:DEBUG|INFO|WARN|TRACE|import|from|\[)", re.M)
_SLOT_HINT = re.compile(r"[{\[<%_@$(&［【＜]|XX_")


def passages(text: str) -> list[str]:
    """The passages of a text, masked, without those that hold no letter and no slot."""
    return [p for p in map(str.strip, _CUT.split(mask(text))) if len(p) > 1 and not p.isdigit() or p >= chr(_SLOT0)]


# -- weak labels -------------------------------------------------------------------------------------------------------

#: Response-status lines, how passages begin that stand where content should, and what occurs in such.
_STATUS = re.compile(
    r"^(?:(?:http|error|status:?|erreur|fehler|ошибка|エラー|错误|오류|erro)\s*:?\s*[45]\d\d\b.*|[45]\d\d\s*[|:–-]?\s*(?:not found|forbidden|unauthorized|bad gateway|service unavailable|internal server error|bad request|gateway time-?out|too many requests|gone|error)"
    r"|(?:not found|forbidden|unauthorized|bad gateway|service unavailable|internal server error|bad request|gateway time-?out|too many requests))[.!]?$",
    re.I,
)
_BEGINNINGS = re.compile(
    r"(?:oops|whoops)\b|access denied[.!]?$|sorry[,.!]?$|something (?:went wrong|broke)|(?:please )?try again (?:later|in)|the link to this [\w ]+ has expired|we could not load"
    r"|no such page|we looked everywhere|you are not allowed to|sign in (?:again )?to continue|could not parse the response|preview unavailable|unexpected failure"
    r"|server trouble|no file exists at this address|an internal problem kept us|you do not have permission|cookies must be allowed|unsupported browser|checking your browser"
    r"|your text goes here|[\w ]+ \d+ goes here|dummy content|more dummy content|body copy to come|replace this [\w ]+ with the real|text text text|nothing to read yet"
    r"|the page you requested has moved|sorry, this file is too big to display|click here to add a description|unhandled exception in page renderer|enable it to continue|this app works best with|to comment or read replies, (?:java ?script|js|scripts)"
    r"|(?:client-side |java ?|running )?script(?:ing|s)?(?: support)? (?:has|have) been disabled|sorry, the [\w ]+ can.t run|to see the [\w ]+, allow scripts|interactive diagram\b.{0,30}script|running scripts is required"
    r"|no [\w ]+ exists at this address|(?:client-side |java ?)?script(?:ing)?(?: support)? seems to be blocked|without (?:java ?script|js|scripting|scripts|script support|running scripts|client-side scripting) there is nothing|enable (?:java ?script|js|scripting|scripts|script support|running scripts|client-side scripting) to|this repository is no longer available"
    r"|write something meaningful in|the server took too long|this [\w ]+ needs a browser with (?:java ?script|scripting|scripts)|contact the administrator of this site|type the [\w ]+ of your|x{3,}\b|platzhaltertext|accès refusé|faux texte|texte factice|texto de ejemplo|texto de exemplo",
    re.I,
)
_MIDDLES = re.compile(
    r"can.t seem to find the page|page (?:you requested |you are looking for )?(?:could not be|cannot be|was not|not) found|temporarily (?:unavailable|away)"
    r"|can.t be shown[.!]?$|that [\w ]+ is private[.!]?$|enable java ?script to|java ?script (?:is disabled|must be enabled|is required)"
    r"|turn on (?:scripts|active content|java ?script)|placeholder (?:copy|text)[;:,.]|to be rewritten[.]?$|seite (?:wurde )?nicht gefunden|blindtext(?: ohne|, der)"
    r"|réessayer (?:plus tard|dans)|nécessite l.exécution de scripts|página no (?:encontrada|existe)|попробуйте (?:позже|ещё раз|еще раз)|ページ(?:は|が)見つかり|ダミーテキスト(?:です|$)"
    r"|javascript(?:를|을) (?:활성|켜|사용)",
    re.I,
)
_LITERALS = (
    "your session has expired",
    "reached the request quota",
    "backend refused the connection",
    "servers are overloaded",
    "was deleted by its owner",
    "gateway got an invalid reply",
    "scripts are required to",
    "needs scripts and cookies",
    "does not start with scripts off",
    "requires a script-enabled client",
    "preciso permitir scripts",
    "could not run its scripts",
    "script blocker prevents",
    "lorem ipsum dolor",
    "dolor sit amet",
    "consectetur adipi",
    "sed do eiusmod",
    "ut labore et dolore",
    "only here to fill the",
    "zugriff verweigert",
    "bitte versuchen sie es später",
    "sitzung ist abgelaufen",
    "aktivieren sie javascript",
    "unterstützt keine skripte",
    "adresse existiert nicht",
    "page introuvable",
    "pas les droits pour",
    "activer javascript",
    "texte de remplissage",
    "acceso denegado",
    "inténtelo de nuevo",
    "los scripts estén habilitados",
    "active javascript",
    "texto de relleno",
    "página não encontrada",
    "acesso negado",
    "tente novamente",
    "ative o javascript",
    "texto provisório",
    "страница не найдена",
    "доступ запрещ",
    "включите javascript",
    "текст-заполнитель",
    "рыба-текст",
    "アクセスが拒否",
    "しばらくしてから",
    "javascriptを有効にして",
    "ここに文章が",
    "後で差し替え",
    "页面不存在",
    "访问被拒绝",
    "请稍后再试",
    "启用javascript",
    "占位文字，",
    "示例文本示例",
    "페이지를 찾을 수 없",
    "접근이 거부",
    "잠시 후 다시",
    "여기에 본문",
    "나중에 바꿔",
)
#: Words of the customary Latin filler; five of them in a row are filler.
_LATIN_WORDS = (
    "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|adipisicing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea"
    "|commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum|vitae"
)
_LATIN = re.compile(rf"(?<![\w])(?:(?:{_LATIN_WORDS})\b[\s,.]*){{5,}}", re.I)
_FIND = ahocorasick.Automaton()
for _word in _LITERALS:
    _FIND.add_word(_word, 1)
_FIND.make_automaton()
_ANY_SLOT = re.compile(f"[{chr(_SLOT0)}-{chr(_SLOT0 + _KINDS - 1)}]")


#: Titles under which an error page puts its message, and ways to say that scripts are needed, by word class.
_TITLED = re.compile(
    r"(?:(?:(?:http|error|status:?) ?)?[45]\d\d ?[|:–-]? ?)?(?:not found|forbidden|unauthorized|bad gateway|service unavailable|internal server error|bad request|(?:gateway|request) time-?out|too many requests|gone)[.:|–-]? (?=(?-i:[A-Z])[\w']*(?: [\w']+){2})"
    r"|(?:(?:http|error|status:?) ?)[45]\d\d[.:|–-]? (?=(?-i:[A-Z]))|(?:sorry|oops|whoops(?:, that did not work)?|something (?:went wrong|broke)|unexpected failure|server trouble)[.!]? (?=(?-i:[A-Z]))"
    r"|(?:this )?[\w ]{1,30} (?:can.t be shown|missing)[.!]? (?=(?-i:[A-Z]))",
    re.I,
)
_SCRIPTS = r"(?:java ?script|js|scripts?|scripting|script support|running scripts|client-side scripting|active content)"
_NOTICE = re.compile(
    rf"\b{_SCRIPTS} (?:(?:is|are|has been|have been|seems? to be|appears? to be) (?:currently )?(?:disabled|required|blocked|needed|turned off|switched off|unavailable)|(?:must|needs? to) be (?:enabled|active|turned on|allowed)|(?:was |were )?not detected)\b"
    rf"|^(?:please |you (?:need|have) to )?(?:enable|allow|activate|turn on|switch on) {_SCRIPTS}\b|\b(?:needs|requires) (?:a browser with )?{_SCRIPTS}(?: and cookies)?(?: (?:turned|switched) on| enabled)?[.]?$"
    rf"|^without {_SCRIPTS} there is|\ballow {_SCRIPTS} (?:and reload|for this)|^if nothing happens, allow"
    r"|禁用(?:了)?(?:脚本|javascript)|启用(?:脚本|javascript)|(?:javascript|スクリプト)(?:を有効に|が無効になって)|(?:자바스크립트|스크립트)(?:를|을|가) ?(?:켜|꺼져|활성)|требуется поддержка (?:скриптов|javascript)|включите (?:скрипты|javascript)",
    re.I,
)
#: That nothing could be sent or drawn, and filler by what it is made of.
_FAILED = re.compile(r"\bfailed to render because\b|\bhas been removed, renamed\b|^the connection was (?:reset|refused|closed)\b|^we are down for maintenance\b|^(?:request|gateway) time-?out$", re.I)
_FILLER = re.compile(
    r"^(?:mock|sample|dummy|placeholder|filler) [\w ]{1,40} (?:for the [\w ]{1,40} template|for layout purposes(?: only)?)[.]?$|^(?:add|enter|insert|type|put|write) your [\w ]{1,40} here[.]?$|^replace me[.]?$"
    r"|\b(?:asdf|qwer|zxcv|jkl)\b.{0,20}\b(?:asdf|qwer|zxcv|jkl)\b|^foo bar baz\b",
    re.I,
)
#: Longest passage that is looked at as a few words said over and over.
REPEATED_CHARS = 400


def _repeated(part: str) -> bool:
    """Whether a passage is one word five times or more, or two or three words three times or more, and nothing else."""
    if len(part) > REPEATED_CHARS:
        return False
    words = part.lower().replace(",", " ").rstrip(".!").split()
    return any(len(words) >= max(3 * k, 5) and words[k:] == words[:-k] and len(set(words)) == k and all(map(str.isalpha, words[:k])) for k in (1, 2, 3))


def _marked(part: str) -> bool:
    """Whether one of the phrases occurs, under a title or without one."""
    said = _TITLED.match(part)
    if said and _BEGINNINGS.match(part, said.end()):
        return True
    if _BEGINNINGS.match(part) or _LATIN.search(part) or _NOTICE.search(part) or _FAILED.search(part) or _FILLER.search(part) or _repeated(part):
        return True
    if said and _STATUS.match(part[: said.end()].rstrip(" .:|–-")):
        return True
    return next(_FIND.iter(part.lower()), None) is not None or _MIDDLES.search(part) is not None


def weak_labels(parts: list[str]) -> list[bool | None]:
    """Which passages of a text the rules mark; None for those that stand in a short text with a status line, of which the
    rules can't say what they are."""
    plain = [p.strip(" \t" + _HEADED + "#=*_-") for p in parts]
    status = [bool(_STATUS.match(p)) for p in plain]
    marks = [s or _marked(p) or bool(_ANY_SLOT.search(p)) for s, p in zip(status, plain)]
    if any(status) and len(parts) <= SHORT_PAGE:
        return [m or None for m in marks]
    return marks


# -- features and classifier -------------------------------------------------------------------------------------------

#: Dense features after the n-grams: slots by kind, then length, place and size of the text in classes.
_SLOT_AT, _LEN_AT = BUCKETS, BUCKETS + 16
_PLACE_AT, _SIZE_AT, _HEAD_AT, _MASK_AT = _LEN_AT + 6, _LEN_AT + 9, _LEN_AT + 13, _LEN_AT + 14
WIDTH = _LEN_AT + 20


def _points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the passages, each after a line end, in lower case with digits alike; and where each begins."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    p = np.frombuffer(("\n" + "\n".join(parts)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    return p, starts


_FOLD = np.arange(0x10000, dtype=np.uint32)
for _c in range(0x10000):
    if 0xD800 <= _c < 0xE000:
        continue
    _l = chr(_c).lower()
    if len(_l) == 1:
        _FOLD[_c] = min(ord(_l), 0xFFFF)
_FOLD[48:58] = 48


def _hashes(p: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) of the n-grams of each order that lie within one passage with its leading line end."""
    folded = _FOLD[np.minimum(p, 0xFFFF)].astype(np.uint32)
    owner = np.zeros(len(p), np.int32)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    h = np.zeros(len(p), np.uint32)
    done = 0
    for order in ORDERS:
        n = len(p) - order + 1
        if n <= 0:
            return
        h = h[:n].copy()
        for k in range(done, order):
            h *= np.uint32(0x01000193)
            h ^= folded[k : k + n]
        done = order
        inside = owner[:n] == owner[order - 1 :]
        mixed = h * np.uint32(0x9E3779B1) + np.uint32(order * 0x1F3D5B79 & 0xFFFFFFFF)
        at = np.flatnonzero(inside)
        yield at, (mixed[at] >> np.uint32(14)).astype(np.int32)


def _dense(parts: list[str], place: np.ndarray, size: np.ndarray, p: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passage, feature) of the dense features."""
    n = np.arange(len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    yield n, _LEN_AT + np.digitize(lengths, (4, 15, 40, 90, 200))
    yield n, _PLACE_AT + np.minimum(place, 2)
    yield n, _SIZE_AT + np.digitize(size, (2, 5, 12))
    at = np.flatnonzero((p >= 0xE000) & (p < _SLOT0 + _KINDS))
    if len(at):
        who, kind = np.searchsorted(starts, at, "right") - 1, p[at].astype(np.int64)
        slot = kind >= _SLOT0
        yield who[slot], _SLOT_AT + kind[slot] - _SLOT0
        hit = np.unique(who[slot])
        yield hit, np.full(len(hit), _MASK_AT + 3)
        for mark, feature in ((_HEADED, _HEAD_AT), (_CODE, _MASK_AT), (_SAID, _MASK_AT + 1), (_LINKED, _MASK_AT + 2)):
            hit = np.unique(who[kind == ord(mark)])
            yield hit, np.full(len(hit), feature)


@dataclass
class Classifier:
    """Weights, and the score from which a passage is residue; what the held-out hosts gave."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.0
    precision: float = 0.0
    recall: float = 0.0
    rules: bool = False  # no sound passage was there to tell the marked ones from, so what the rules mark is residue

    def scores(self, parts: list[str], place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of every passage."""
        p, starts = _points(parts)
        sums, counts = np.zeros(len(p) + 1), np.zeros(len(p) + 1)
        for at, bucket in _hashes(p, starts):
            sums[at] += self.weights[bucket]
            counts[at] += 1
        total = np.add.reduceat(np.append(sums, 0.0), np.append(starts, len(p)))[:-1] if len(starts) else np.zeros(0)
        n = np.add.reduceat(np.append(counts, 0.0), np.append(starts, len(p)))[:-1] if len(starts) else np.zeros(0)
        out = self.bias + total / np.sqrt(np.maximum(n, 1))
        for i, f in _dense(parts, place, size, p, starts):
            np.add.at(out, i, self.weights[f])
        return out


def fit(parts: list[str], place: np.ndarray, size: np.ndarray, labels: np.ndarray, fold: np.ndarray, counts: np.ndarray) -> Classifier:
    """Logistic regression with an L2 penalty, classes weighted alike in total up to a factor.

    Rules miss cases, so passages without a mark aren't all sound. Every passage is scored by a fit without its ``fold``
    (its hosts); those without a mark that score like the upper marked ones (``DOUBT``) are doubtful and left out. A
    second round without them gives the scores from which the lowest threshold is taken whose F1 is near the best (``NEAR_BEST``), not below ``LEAST``, and
    the last fit is made in the same way over all folds. Where the marked passages stand in too few folds, passages are
    dealt to the folds one by one. Deterministic. Without any marked passage it marks nothing, without any sound one what
    the rules mark.
    """
    if not len(parts) or not labels.any():
        return Classifier(np.zeros(WIDTH, np.float32), -1.0)
    if labels.all():
        return Classifier(np.zeros(WIDTH, np.float32), -1.0, rules=True)
    p, starts = _points(parts)
    owner = np.zeros(len(p), np.int32)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    rows, cols = [], []
    n = np.zeros(len(parts), np.int64)
    for at, bucket in _hashes(p, starts):
        who = owner[at]
        n += np.bincount(who, minlength=len(parts))
        seen = np.bincount(bucket, weights=counts[who], minlength=BUCKETS)
        marked = np.zeros(BUCKETS, bool)
        marked[bucket[labels[who]]] = True
        # n-grams of no marked passage could only speak against, as the bias does; those seen once tell nothing of others
        kept = (marked & (seen > 1))[bucket]
        rows.append(who[kept])
        cols.append(bucket[kept])
    n = np.maximum(n, 1)
    values = [(1 / np.sqrt(n[r])).astype(np.float32) for r in rows]
    for i, f in _dense(parts, place, size, p, starts):
        rows.append(i.astype(np.int32))
        cols.append(f.astype(np.int32))
        values.append(np.ones(len(i), np.float32))
    matrix = _sorted(np.concatenate(rows), np.concatenate(cols), np.concatenate(values).astype(np.float64))
    row, col, value = matrix[0]
    fold = fold.astype(np.int64)
    if len(np.unique(fold[labels])) < 2 or len(np.unique(fold[~labels])) < 2:
        fold = np.arange(len(parts)) % FOLDS
    used = np.ones(len(parts), bool)

    so_far: dict[int, tuple[np.ndarray, float]] = {}

    def unseen(epochs: int) -> np.ndarray:
        z = np.zeros(len(parts))
        for f in np.unique(fold).tolist():
            w, b = so_far[f] = _descend(matrix, labels, counts, used & (fold != f), epochs, *so_far.get(f, (None, 0.0)))
            at = fold[row] == f
            z += np.bincount(row[at], weights=w[col[at]] * value[at], minlength=len(parts)) + np.where(fold == f, b, 0.0)
        return z

    z = unseen(FOLD_EPOCHS)
    used = labels | (z < np.quantile(z[labels], DOUBT))
    z = unseen(MORE_EPOCHS)
    tried = []
    for t in np.linspace(LEAST, 4.0, 36):
        hit = used & (z >= t)
        tp = counts[hit & labels].sum()
        precision, recall = tp / max(1, counts[hit].sum()), tp / max(1, counts[labels].sum())
        tried.append((2 * precision * recall / max(1e-9, precision + recall), float(t), precision, recall))
    best = next(x for x in tried if x[0] >= max(tried)[0] - NEAR_BEST)  # what the rules miss counts against a low one
    w, b = _descend(matrix, labels, counts, used, EPOCHS)
    return Classifier(w.astype(np.float32), float(b), *best[1:])


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sorted(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> tuple[Entries, Entries]:
    """The entries of a sparse matrix by row and by column."""
    by_row, by_col = np.argsort(row, kind="stable"), np.argsort(col, kind="stable")
    return (row[by_row], col[by_row], value[by_row]), (row[by_col], col[by_col], value[by_col])


def _descend(matrix: tuple[Entries, Entries], labels: np.ndarray, counts: np.ndarray, train: np.ndarray, epochs: int, w: np.ndarray | None = None, b: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias from the passages in ``train``, by scaled gradient steps over all of them at once, on from ``w``, ``b``."""
    (r, c, v), (r_of, c_of, v_of) = (tuple(x[train[e[0]]] for x in e) for e in matrix)
    rows, at_row = np.unique(r, return_index=True)
    cols, at_col = np.unique(c_of, return_index=True)
    y = labels.astype(np.float64)
    n_pos, n_neg = max(1, int((labels & train).sum())), max(1, int((~labels & train).sum()))
    weight = np.where(labels, min(20.0, n_neg / n_pos), 1.0) * np.sqrt(counts) * train
    weight /= max(weight.sum(), 1e-12)
    w = np.zeros(WIDTH) if w is None else w.copy()
    squares, b_square = np.full(WIDTH, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.full(len(labels), b)
        if len(rows):
            z[rows] += np.add.reduceat(w[c] * v, at_row)
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = RIDGE * w
        if len(cols):
            grad[cols] += np.add.reduceat(slope[r_of] * v_of, at_col)
        squares = 0.9 * squares + 0.1 * grad * grad
        w -= 0.1 * grad / (np.sqrt(squares) + 1e-6)
        g = slope.sum()
        b_square = 0.9 * b_square + 0.1 * g * g
        b -= 0.05 * g / (np.sqrt(b_square) + 1e-6)
    return w, b


# -- on Spark ----------------------------------------------------------------------------------------------------------

_DRAWN = pa.schema([("host", pa.string()), ("passage", pa.string()), ("place", pa.int32()), ("size", pa.int32()), ("label", pa.bool_())])


#: Passages up to this length are always drawn: menus and short replies, which stand in sound and in other texts alike.
MENU_CHARS = 40
#: Words that error pages, filler and notices share with text that only speaks of them; such are always drawn.
_NEAR = re.compile(
    r"script|not found|gateway|forbidden|unavailable|denied|lorem|placeholder|platzhalter|blindtext|texte?\b|texto|error|erreur|fehler|ошибк|шаблон|заполнит|エラー|記号|ダミー|错误|模板|占位|返回\d|오류|자리|[45]\d\d",
    re.I,
)
_DIGITS = re.compile(r"\d")


def _draw(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = passages(text)
                labels = weak_labels(parts)
                size = len(parts)
                for k, (part, label) in enumerate(zip(parts, labels)):
                    if label is None:
                        continue
                    if label or len(part) <= MENU_CHARS or _NEAR.search(part) or (len(text) + 31 * k + 7 * len(part)) % every == 0:
                        out.append((host, _DIGITS.sub("0", part), k, size, label))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_DRAWN)], schema=_DRAWN)

    return run


def train(documents: DataFrame, bound: int = LABELLED_DOCUMENTS, unlabelled: int = UNLABELLED_PASSAGES) -> Classifier:
    """Fits the classifier on passages of at most about ``bound`` documents, drawn by the hash of their text.

    Of these passages at most ``2 * unlabelled`` marked ones and as many others are taken, each by the order of their
    hash, so that neither kind crowds out the other. Hosts are dealt into ``FOLDS`` parts by the hash of their name. A
    passage weighs as the root of its occurrences, and is marked if all of them are.
    """
    n = documents.count()
    share = min(1.0, bound / max(1, n))
    drawn = documents.filter("text is not null and trim(text) <> ''").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40)))
    every = max(1, int(n * share * 12 / unlabelled))
    told = spread(drawn.select(F.coalesce("project", F.lit("none")).alias("host"), "text")).mapInArrow(_draw(every), "host string, passage string, place int, size int, label boolean")
    told = told.groupBy("passage").agg(F.min("host").alias("host"), F.min("place").alias("place"), F.min("size").alias("size"), F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
    told = cut_lineage(told.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS))))
    some = lambda which: told.filter(which).orderBy(F.xxhash64("passage"), "passage").limit(2 * unlabelled)
    got = some("label").unionByName(some("not label")).toArrow()
    col = {c: got.column(c).to_numpy(zero_copy_only=False) for c in ("place", "size", "label", "fold", "n")}
    return fit(got.column("passage").to_pylist(), col["place"].astype(np.int64), col["size"].astype(np.int64), col["label"].astype(bool), col["fold"], col["n"].astype(np.float64))


def best_passages(texts: list[str | None], model: Classifier) -> list[tuple[float, str] | None]:
    """The highest score in each text and its passage."""
    out: list[tuple[float, str] | None] = [None] * len(texts)
    parts: list[str] = []
    owner: list[int] = []
    place: list[int] = []
    size: list[int] = []
    chars = 0

    def flush() -> None:
        if not parts:
            return
        scores = model.scores(parts, np.array(place, np.int64), np.array(size, np.int64))
        for i in np.flatnonzero(scores >= model.threshold).tolist():
            o, s = owner[i], float(scores[i])
            if out[o] is None or s > out[o][0]:
                out[o] = (s, parts[i])
        for x in (parts, owner, place, size):
            x.clear()

    for o, text in enumerate(texts):
        if not text or text.isspace():
            continue
        found = passages(text)
        if model.rules:
            out[o] = next(((1.0, p) for p, marked in zip(found, weak_labels(found)) if marked), None)
            continue
        parts += found
        owner += [o] * len(found)
        place += range(len(found))
        size += [len(found)] * len(found)
        chars += len(text)
        if chars > CHUNK_CHARS:
            flush()
            chars = 0
    flush()
    return out


def residue(documents: DataFrame, model: Classifier | None = None) -> DataFrame:
    """``doc_id, score, passage`` of the documents with at least one passage of residue; the passage is the worst, masked.

    Needs ``doc_id, text, project``; other columns are ignored. Null, empty and blank texts are none. Rows with equal
    doc_id or text are judged each. Texts are judged whole. An empty table gives none.
    """
    spark = documents.sparkSession
    model = model or train(documents)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,passage:string>")
    def judge(texts: pa.Array) -> pa.Array:
        m = shared.value
        best = best_passages(texts.to_pylist(), m)
        return pa.array([None if b is None or b[0] < m.threshold else {"score": b[0], "passage": b[1]} for b in best], pa.struct([("score", pa.float64()), ("passage", pa.string())]))

    return spread(documents.select("doc_id", "text")).select("doc_id", judge("text").alias("worst")).filter("worst is not null").select("doc_id", "worst.score", "worst.passage")


def without_residue(documents: DataFrame, model: Classifier | None = None) -> DataFrame:
    """The documents that have none, all columns as they are. Rows with a null doc_id stay only if none of them is hit."""
    bad = residue(documents, model).select(F.col("doc_id").alias("_bad")).distinct()
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")
