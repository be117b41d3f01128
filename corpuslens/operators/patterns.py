"""Patterns, word lists, weights and messages. Fixed values throughout."""

#: Formulaic phrasing: (pattern, label).
AI_PATTERNS = [
    (r"从[^，。]{1,12}(角度|维度|层面|视角)看", "视角模板句"),
    (r"通过[^，。]{1,15}等途径", "罗列型句子"),
    (r"首先[^，。]{0,10}其次[^，。]{0,10}最后", "首先/其次/最后"),
    (r"不仅[^，。]{1,20}而且", "不仅/而且"),
    (r"面对(这个|这些)?(挑战|问题)", "面对挑战句式"),
    (r"发挥着?[^，。]{1,12}的作用", "发挥着作用"),
    (r"提供了(有力|重要|坚实)的?支撑", "提供了支撑"),
    (r"综上所述|总的来说|总而言之", "总结模板句"),
    (r"是[^，。]{1,15}的(体现|证明|保障|关键)", "是…的…结构"),
    (r"(全方位|多层次|复合型|一体化)[、，]?(全方位|多层次|复合型|一体化)[、，]?(全方位|多层次|复合型|一体化)", "三段式排比"),
    (r"赋能|抓手|闭环|一站式|无缝对接", "AI 高频词"),
    (r"具有重要意义|值得关注|不可忽视|具有深远", "空话短语"),
    (r"不断|持续优化|进一步加强|深入推进", "虚化动词"),
]
#: For each of the patterns above, literals without any of which a text has no match.
AI_HINTS = [("角度看", "维度看", "层面看", "视角看"), ("等途径",), ("首先",), ("不仅",), ("面对",), ("发挥",), ("提供了",), ("综上所述", "总的来说", "总而言之"), ("的体现", "的证明", "的保障", "的关键"), ("全方位", "多层次", "复合型", "一体化"), ("赋能", "抓手", "闭环", "一站式", "无缝对接"), ("具有重要意义", "值得关注", "不可忽视", "具有深远"), ("不断", "持续优化", "进一步加强", "深入推进")]
FILLERS = ["的话", "这块儿", "说白了", "一般来说", "某种程度上", "众所周知"]
FILLER_LABEL = "口语填充词"
#: Headings without content, and lines without content.
EMPTY_HEADINGS = [r"^#+.*(具有重要意义|值得关注|不可忽视|值得肯定|意义重大)"]
EMPTY_LINES = [r"(具有重要意义|值得关注|不可忽视|值得肯定)", r"^(综上所述|总的来说|总之)[，。]?$", r"^[^。]{0,30}的(体现|证明|保障)。?$"]
#: Spellings of a term: (pattern, canonical form).
TERM_VARIANTS = [
    (r"\b(React|react)\b", "React"),
    (r"\b(API|Api|api)\b", "API"),
    (r"\b(TypeScript|Typescript|typescript)\b", "TypeScript"),
    (r"\b(Markdown|markdown|MarkDown)\b", "Markdown"),
    (r"\b(Docker|docker)\b", "Docker"),
    (r"\b(GitHub|Github|github)\b", "GitHub"),
    (r"\b(Word|word)\b", "Word"),
    (r"\b(JSON|Json|json)\b", "JSON"),
    (r"\b(H3|h3)\b", "H3"),
    (r"\b(HTTP|Http|http)\b", "HTTP"),
]
#: The spellings that each of the patterns above looks for.
SPELLINGS = [tuple(p[3:-3].split("|")) for p, _ in TERM_VARIANTS]
EMPTY_HINTS = ("具有重要意义", "值得关注", "不可忽视", "值得肯定", "意义重大", "综上所述", "总的来说", "总之", "的体现", "的证明", "的保障")
FIGURE, TABLE = "图", "表"
SECTION = r"^(#{2,4})\s+(\d+(?:\.\d+)*)\.?\s"
#: (kind, weight, cap) of the score.
PENALTIES = [("ai", 2, 30), ("filler", 1, 10), ("figure_table", 3, 20), ("quote", 1, 10), ("empty", 2, 15), ("term", 2, 10), ("code", 2, 10), ("section", 2, 10)]
GOOD_SCORE = 85

DELAY = r"(往返时延|往返时间|RTT|round[- ]trip)"
HALF = r"(一半|单程|半个往返)"
ONE_WAY = "单程"
QUANTITY = r"(窗口(?:大小)?|时延|延迟|往返时延|RTT|序号|确认号|字数|文件大小|耗时)[：: =约为]*\s*([0-9]+(?:\.[0-9]+)?)\s*(ms|毫秒|s|秒|字|KB|MB|bytes?)"
QUANTITY_HINTS = ("窗口", "时延", "延迟", "RTT", "rtt", "Rtt", "序号", "确认号", "字数", "文件大小", "耗时")
PLACEHOLDER_HINTS = ("占位", "待填", "待补充", "示例", "示意")
PLACEHOLDER = r"(占位|待填|待补充|示例|示意)"
HEX = r"0x[0-9A-Fa-f]{2,4}"
RELATIVE = r"(相对序号|relative sequence)"
ABSOLUTE = r"(原始序号|绝对序号|absolute sequence)"
#: In lower case, literals without any of which a text has no match of the patterns above.
DELAY_HINTS, HALF_HINTS = ("往返时延", "往返时间", "rtt", "round"), ("一半", "单程", "半个往返")
RELATIVE_HINTS, ABSOLUTE_HINTS = ("相对序号", "relative"), ("原始序号", "绝对序号", "olute")
DELAY_REACH, BASIS_REACH, CONTEXT = 40, 8, 60
SENTENCE_ENDS = "。！？!?；;"

VERSION = r"\bv?\d+\.\d+(?:\.\d+)?\b"
NUMBER = r"(\d[\d,\.]*)\s*(MB|GB|KB|MiB|ms|s\b|分钟|km²|km|米|个|条|格|节点|边|人|万|%|倍)"
TERM = r"\b[A-Z][A-Za-z0-9]{2,}(?:\s[A-Z][A-Za-z0-9]{2,})?\b"
TABLE_RULE = r"^\|?[\s:|-]+\|?$"
CAPTION_MOST = 28
#: A caption after a table or an image.
CAPTION = r"^(图|表)(\d+)"

#: Source listings.
CODE_EXTENSIONS = ["ts", "tsx", "js", "mjs", "jsx", "css", "py", "java", "go", "rs", "c", "h", "cpp", "cs", "vue", "html", "json", "sql", "sh", "yml", "yaml"]
NOISE_FOLDERS = ["node_modules", ".git", "dist", "build", "__pycache__", ".next", ".nuxt", ".venv", ".idea", ".vscode"]
NOISE_PREFIXES = ["node_modules", ".git"]
NOISE_ENDS = [".min.js", ".min.css", ".map", ".d.ts.map"]
BARE_NAMES = ["Dockerfile", "Makefile"]
