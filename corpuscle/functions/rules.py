"""Ordered rewrite chains and predicates, as data.

A chain is a tuple of rules; the same table drives cleaning, per-step counters and tests. Patterns are Java
regular expressions. The order inside a chain is part of its meaning.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """needs: texts that hold none of these, in any case, can't match, so the pattern isn't tried on them; `0` stands for
    any digit. Empty: it is always tried."""

    step: str
    pattern: str
    replacement: str = ""
    needs: tuple[str, ...] = ()


def rx(pattern: str, flags: str = "") -> str:
    """Unicode classes and `\\n` as the only line end, as in Python; flags: i, m, s."""
    return f"(?Ud{flags}){pattern}"


# ---- Fixed values: patterns, key words and limits that results depend on -------------------------

SPAM = (
    r"byvn\.net/\S+",
    r"share cho m[aấ]y (th[iíy]m|b[aá]c|[aâ]nh em) con deal",
    r"(rút gọn|áp\s+dc|áp\s+được)\s+(full\s+)?mã\s+giảm",
    r"mã\s+giảm\s+giá.{0,30}(sale|giảm)\s*\d+[%k]",
    r"chuột\s+bạch\s+xem",
    r"quốc\s+hàng\s+của\s+vozer",
)
TERMINAL_ANY_CASE = (
    r"^(sudo|apt|pkg|pip|npm|git|cd|ls|rm|mv|cp|chmod|chown|grep|awk|sed|curl|wget)\s",
    r"^(pkg upgrade|su|debugging|force-vp9|header-switch)$",
)
TERMINAL = (r"^\$\s+\w+", r"^>>>\s+\w+", r"^#\s*!/\w+")
MIN_WORDS, MAX_CHARS, MIN_LINE_CHARS, MIN_FORUM_WORDS, MAX_WORD_REPEATS = 15, 5000, 7, 4, 5
CODE_WORDS = (
    "script", "html", "div", "doctype", "src", "href", "interface", "ethernet", "pppoe", "wlan", "ssid", "dhcp",
    "mikrotik", "hotspot", "default-name", "supplicant", "wpa2", "ap-bridge",
)
TOKEN = "[a-zàáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ0-9]+"
TOKEN_NOISE = r"<url>|https?://\S+|www\.\S+"
PARAGRAPH_CHARS = {"vnexpress.net": 50, "dantri.com.vn": 40, "thanhnien.vn": 40, "voz.vn": 25}
BOT_WALL = ("Just a moment...", "Checking your browser")
ORPHANS = (",", ".", "!", "?", ":", "-", '"')

#: Comment cleaning, in place.
COMMENT = (
    Rule("signature", rx(r"\bvia\s+the\w*voz\w*\s+for\s+\w+", "i"), needs=("voz",)),
    Rule("signature", rx(r"\bSent\s+from\s+.{3,60}\s+using\s+voz\w+", "i"), needs=("voz",)),
    Rule("signature", rx(r"\bGửi\s+từ\s+.{2,60}\s+bằng\s+\w+App\b", "i"), needs=("app",)),
    Rule("signature", rx(r"\bvia\s+\w+\s+for\s+(iPhone|Android|iPad)\b", "i"), needs=("iphone", "android", "ipad")),
    Rule("facebook", rx(r"Log\s+in\s+(to|or sign up to view)\s+Facebook.*?(?=\n|$)", "is"), needs=("facebook",)),
    Rule(
        "url",
        rx(r"https?://\S+|(?<!\w)www\.\S+|(?<!\w)vn\.shp\.ee/\S+|(?<!\w)s\.lazada\.vn/\S+|(?<!\w)bit\.ly/\S+|(?<!\w)shopee\.vn/\S+", "i"),
        "<URL>",
        needs=("http", "www.", "vn.shp.ee", "s.lazada.vn", "bit.ly", "shopee.vn"),
    ),
    Rule("metadata", rx(r"Post\s+in\s+thread\s+['\"].+?['\"]", "i"), needs=("thread",)),
    Rule("metadata", rx(r"Replies:\s*\d+\s+Forum:\s*\w+", "i"), needs=("replies:",)),
    Rule("metadata", rx(r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+20\d{2}\b", "i"), needs=("0",)),
    Rule("metadata", rx(r"\b\d{1,2}/\d{1,2}/20\d{2}\b"), needs=("/20",)),
    Rule("repeat", rx(r"([.!?\-_~])\1{3,}"), "$1", ("....", "!!!!", "????", "----", "____", "~~~~")),
    Rule("repeat", rx(r"([^.!?\-_~\n])\1{3,}"), "$1$1"),
    Rule("emoticon", rx(r"(?<!\w):v\b", "i"), needs=(":v",)),
    Rule("emoticon", rx(r"(?<!\w):\)\s*$", "m"), needs=(":)",)),
    Rule("emoticon", rx(r"\){3,}"), needs=(")))",)),
    Rule("emoticon", rx(r"(?<!\w)=\)\s*$", "m"), needs=("=)",)),
    Rule("emoticon", rx(r"(?<!\w)>\.<"), needs=(">.<",)),
    Rule("emoticon", rx(r"(?<!\w): \w+:(?!\w)"), needs=(": ",)),
    Rule("emoji", rx(r"[\x{10000}-\x{10ffff}]|[\u2600-\u27BF]|[\u2300-\u23FF]|[\u25A0-\u25FF]|[\u2700-\u27BF]")),
    Rule("punctuation", rx(r"([!?])[!?]{2,}"), "$1", ("!!", "??", "!?", "?!")),
    Rule("punctuation", rx(r"\.{4,}"), ".", ("....",)),
    Rule("whitespace", rx(r"[ \t]{2,}"), " ", ("  ", "\t")),
)
COMMENT_COUNTED = ("signature", "facebook", "url", "metadata", "repeat", "emoticon", "emoji", "punctuation", "truncate")

#: Line cleaning. `:)` needs two closing brackets or more; `>` deletes to the line's end.
LINE = (
    Rule("url", rx(r"https?://\S+|www\.\S+|ftp://\S+"), needs=("http", "www.", "ftp:")),
    Rule("image", rx(r"\[Hình ảnh\]|\[hình ảnh\]|\[image\]|\[img\]", "i"), needs=("[",)),
    Rule("quote", rx(r">{1,}\s*.*"), needs=(">",)),
    Rule("signature", rx(r"-{2,}\s*$"), needs=("--",)),
    Rule("emoticon", rx(r"=\)+|:\){2,}|:>+|;\)+|:D+|>\.<|T_T|:\|+|>_<|:v+|:\*+|<3+")),
    Rule("brackets", rx(r"\(\s*\)"), needs=("(",)),
    Rule("dots", rx(r"\.{2,}"), ".", ("..",)),
    Rule("spaces", rx(r" {2,}"), " ", ("  ",)),
)

_WEB = (Rule("url", rx(r"https?\s*:\s*/\s*/\s*\S+"), " ", ("http",)), Rule("email", rx(r"\S+@\S+\.\S+"), " ", ("@",)))
_ELLIPSIS = Rule("ellipsis", rx(r"\.{3,}"), "…", ("...",))
_MARKS = (
    Rule("space_before", rx(r"\s+([,.:;!?…])"), "$1"),
    Rule("space_after", rx(r"([,:;!?])(?=[^\s\d\"”\)])"), "$1 "),
)
_SPACES = Rule("spaces", rx(r" +"), " ")

#: Forum texts, before and after normalisation to NFC, and after lower-casing.
FORUM_RAW = (
    Rule("quote", rx(r"\[QUOTE\].*?\[/QUOTE\]", "is"), " ", ("[quote]",)),
    Rule("signature", rx(r"Sent from (my )?[a-zA-Z0-9 ]+ using .*", "i"), " ", ("sent from ",)),
    Rule("signature", rx(r"Sent from .* via .*", "i"), " ", ("sent from ",)),
    Rule("signature", rx(r"via theNEXTvoz.*", "i"), " ", ("via thenextvoz",)),
    Rule("signature", rx(r"Gửi từ .* bằng .*", "i"), " ", ("gửi từ ",)),
)
FORUM_WEB = _WEB
#: Terms that stay together. Without a suffix the next word is drawn in; `entities(fixed=True)` avoids that.
ENTITIES = (
    Rule("unit", rx(r"\b(\d+)\s*(k|vnd|đ|nd|th|st|rd|gb|tb|hz|mhz|p|fps)\b"), "$1$2", ("0",)),
    Rule("inch", rx(r"(?<![-/a-z])\b(\d+)\s*[\"']"), "$1inch ", ("0",)),
    Rule("cpu", rx(r"\b(i|r)\s*(\d)\s*[-_]?\s*(\d{4,5})\s*([kxf]{0,2})\b"), "$1$2_$3$4", ("0",)),
    Rule("gpu", rx(r"\b(rtx|gtx|rx|hd|gt)\s*[-_]?\s*(\d{3,4})\s*[-_]?\s*(ti|xt|super)\b"), "$1_$2_$3", ("0",)),
    Rule("gpu", rx(r"\b(rtx|gtx|rx|hd|gt)\s*[-_]?\s*(\d{3,4})\s*[-_]?\s*\b"), "$1_$2", ("0",)),
    Rule("gear", rx(r"\b(logitech|corsair|fuhlen|mchose|vxe|razer|dareu)\s+([a-z0-9]+)\b"), "$1_$2", ("logitech", "corsair", "fuhlen", "mchose", "vxe", "razer", "dareu")),
)
ENTITIES_FIXED = tuple(
    {
        "cpu": Rule("cpu", rx(r"\b(i|r)\s*(\d)\s*[-_]?\s*(\d{4,5})(?:\s*([kxf]{1,2}))?\b"), "$1$2_$3$4"),
        rx(r"\b(rtx|gtx|rx|hd|gt)\s*[-_]?\s*(\d{3,4})\s*[-_]?\s*\b"): Rule("gpu", rx(r"\b(rtx|gtx|rx|hd|gt)\s*[-_]?\s*(\d{3,4})\b"), "$1_$2"),
    }.get(r.step if r.step == "cpu" else r.pattern, r)
    for r in ENTITIES
)
FORUM_MARKS = (_ELLIPSIS, *_MARKS, _SPACES)

#: News texts, after NBSP and quotation marks. The ranges go by code point and hold letters of either case.
NEWS = (
    *_WEB, _ELLIPSIS, *_MARKS,
    Rule("sentence_gap", rx(r"(?<=[a-zà-ỹ])\.(?=[A-ZÀ-Ỹ])"), ". "),
    _SPACES,
)

#: Last polish, after bracket balancing.
POLISH = (Rule("space_before", rx(r"\s+([.?!:;])"), "$1"), Rule("ellipsis", rx(r"\.\s*\.\s*\."), "..."))

#: Paragraphs of web pages.
PARAGRAPH = (Rule("more", rx(r">>\s*Xem thêm:.*$", "i")), Rule("invite", rx(r"Mời các bạn tham gia.*$", "i")), Rule("spaces", rx(r"\s+"), " "))

#: Around punctuation before word segmentation. The marks of the second rule are deleted; fixed: set apart.
SEGMENT_MARKS = (
    Rule("stops", rx(r"(?<!\d)([.,])(?!\d)"), " $1 "),
    Rule("marks", rx(r"[!?;:()\[\]{}”\"’']"), "  "),
    Rule("spaces", rx(r"[ \t]{2,}"), " "),
)
ENTITY = rx(r"\b\w+(?:_\w+)+\b")
