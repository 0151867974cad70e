"""Does a sentence go on from one cue to the next in scripts without blanks? Lists of words decide, and where a word may be
part of another, the first or last token of eight characters beside the edge."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import edges as E

WINDOW = 8
STRONG = E.TAIL_TERMINAL | E.TAIL_ELLIPSIS | E.TAIL_CLOSED | E.TAIL_DASH


@dataclass(frozen=True)
class Lexicon:
    """Words that may not begin a cue or end one, phrases that may not end one, endings that are complete all the same,
    and what begins a sentence, goes on with one, or begins a turn (single characters)."""

    no_start: tuple[str, ...] = ()
    no_end: tuple[str, ...] = ()
    no_end_phrases: tuple[str, ...] = ()
    complete: tuple[str, ...] = ()
    begins: tuple[str, ...] = ()
    continues: tuple[str, ...] = ()
    turns: str = "（(【[-－―"


# Japanese words.
JAPANESE = Lexicon(
    no_start=tuple("を に が と から まで より ので のに ても ば たり だり ながら つつ ぞ ぜ かな かしら です ます ました でした".split()),
    no_end=tuple("を は も が と より まで ば ながら つつ ので たり だり という によって による として について 途端 とたん".split()),
    no_end_phrases=tuple("ために ための ような ずに ないで くせに ものの うちに".split()),
    complete=tuple("こんにちは こんばんは どうも これまで 今まで ここまで そこまで どこまで あそこまで っと ちゃんと ほんと ふと".split()),
    begins=tuple("ええ えっ あっ ああ あ いや うん はい おい ほら まあ さあ ねえ なあ もう でも だから じゃあ じゃ それで そして しかし だが だけど ところで つまり えーと うーん ちょっと すみません ありがとう".split()),
)

# Chinese words. Those that also stand alone or call out are not bound to an edge.
FREE_ENCLITICS = set("呢 啊 哇 哈 哎 耶 呀 哟 喲 过 過 得 地 罢 罷 等等 先 定 咪 咩 倒 翻 返 掂".split())
FREE_PROCLITICS = set("对 對 给 給 借 藉 按 这 這 这个 這個 这些 這些 那 那个 那個 那些 哪 每 各 各个 呢 呢個 呢啲 嗰 嗰個 嗰啲 邊個 邊度 點解".split())
MORE_ENCLITICS = tuple("嘛 么 麼 而已 罢了 罷了 似的".split())
MORE_ENDS = tuple("然后 然後 不过 不過 可是 而是 以便 由于 由於 除了 通过 通過 随着 隨著 除非 的话 的話 之后 之後 之前".split())
END_PHRASES = tuple("的时候 的時候".split())
BEGINS = tuple("嗯 啊 哦 喔 噢 喂 哎 唉 嘿 呃 哈 哇 哟 咦 谢谢 謝謝 对不起 對不起 你好 再见 再見 好的 好吧".split())
CONTINUES = tuple("但是 但係 可是 而且 并且 並且 所以 因此 然后 然後 而是 于是 於是 以及 或者 但 而 并 並 却 卻".split())


def chinese(enclitics: str, proclitics: str, conjunctions: str) -> Lexicon:
    """Of a way of writing: enclitics may not begin a cue, proclitics and conjunctions may not end one."""
    return Lexicon(
        no_start=tuple(w for w in enclitics.split() if w not in FREE_ENCLITICS) + MORE_ENCLITICS,
        no_end=tuple(w for w in proclitics.split() if w not in FREE_PROCLITICS) + tuple(conjunctions.split()) + MORE_ENDS,
        no_end_phrases=END_PHRASES, begins=BEGINS, continues=CONTINUES,
    )


# Enclitics, proclitics and conjunctions of simplified and traditional Chinese and of Cantonese.
SIMPLIFIED = chinese(
    "的 地 得 了 着 过 吗 呢 吧 啊 呀 哇 啦 罢 哩 呗 嘞 咯 哈 哟 哎 耶 们 等等",
    "在 从 向 往 对 给 把 被 与 和 跟 同 随 自 于 由 按 按照 根据 为 为了 朝 凭 借 沿 沿着 趁 趁着 这 这个 这些 那 那个 那些 哪 各个 每 以及 关于 有关 对于",
    "并且 而且 但是 然而 或者 还是 因而 所以 虽然 尽管 不仅 不但 如果 要是 即使 哪怕 只有 只要 因为 既然",
)
TRADITIONAL = chinese(
    "的 地 得 了 著 過 嗎 呢 吧 啊 呀 哇 啦 罷 哩 唄 嘞 咯 哈 喲 哎 耶 們 等等",
    "在 從 向 往 對 給 把 被 與 和 跟 同 隨 自 於 由 按 按照 根據 為 為了 朝 憑 藉 沿 沿著 趁 趁著 這 這個 這些 那 那個 那些 哪 各 每 以及 關於 有關 對於",
    "並且 而且 但是 然而 或者 還是 因而 所以 雖然 儘管 不僅 不但 如果 要是 即使 哪怕 只有 只要 因為 既然",
)
CANTONESE = chinese(
    "嘅 咗 緊 過 喇 咩 呢 咪 呀 喎 㗎 啫 囉 哩 晒 埋 掂 倒 翻 返 添 咋 嘞 啩 啝 先 定 哋",
    "喺 喺度 由 向 畀 同 將 自 跟 到 由得 為咗 趁 照 順 呢 呢個 呢啲 嗰 嗰個 嗰啲 邊個 邊度 點解 關於 同埋",
    "而且 但係 不過 或者 所以 如果 同埋 抑或 因為 既然 縱使 雖然 就算 只要",
)


def content(text: Column) -> Column:
    """The text up to its last character before blanks, notes, closing quotes and closing style tags."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, rf"(?:{E.char_class(E.BLANK + E.NOTES + E.CLOSERS + E.STRAIGHT)}|</[ibuIBU]>)++$", "")


def begun(text: Column) -> Column:
    """The text from its first character after blanks, notes and style tags."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^(?:{E.char_class(E.BLANK + E.NOTES)}|{E.STYLE})++", "")


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")" if words else "(?!)"


def goes_on(before: Column, tail: Column, text: Column, gap: Column, words: Lexicon, tokens: Callable[[Column], Column]) -> Column:
    """Does a sentence go on from the text before (with its tail flags) after a gap in milliseconds? tokens cuts a text
    (pieces.word_tokens). Nothing goes on after strong signs or more than 1.5 s. Null texts are empty; a null gap gives null."""
    left, right = content(before), begun(text)
    edge = lambda found, n: F.coalesce(F.try_element_at(found, F.lit(n))["text"], F.lit(""))
    last, first = edge(tokens(F.right(left, F.lit(WINDOW))), -1), edge(tokens(F.left(right, F.lit(WINDOW))), 1)
    ends = lambda some: left.rlike(_any(some) + "$")
    starts = lambda some: right.rlike("^" + _any(some))
    unfinished = ends(words.no_end_phrases) | (ends(words.no_end) & ~ends(words.complete) & last.isin(*words.no_end))
    turn = right.rlike("^" + E.char_class(words.turns)) | starts(words.begins) if words.turns else starts(words.begins)
    bound = starts(words.no_start) & first.isin(*words.no_start)
    return F.when((tail.bitwiseAND(STRONG) != 0) | (gap > E.ADJACENT_MS), False).when(gap.isNull(), None).when(E.has(tail, E.TAIL_CONTINUATION) | unfinished, ~turn).otherwise(bound | starts(words.continues))
