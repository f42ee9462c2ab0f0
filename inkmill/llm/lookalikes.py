"""Characters that a reader cannot tell apart although neither NFKC nor case folding relates them."""

# Letters of other scripts and the Latin letters they look like.
LETTERS = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian and Latin extensions
    "օ": "o", "ո": "n", "ս": "u", "ց": "g", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}

# Radicals that are printed like whole characters but have no compatibility mapping.
RADICALS = {
    "⺁": "厂", "⺅": "亻", "⺆": "冂", "⺉": "刂", "⺊": "卜", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺒": "巳", "⺓": "幺", "⺔": "彑", "⺕": "彐", "⺖": "忄", "⺘": "扌", "⺙": "攵", "⺛": "旡",
    "⺝": "月", "⺞": "歺", "⺟": "母", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺦": "丬", "⺨": "犭", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻", "⺯": "糹", "⺰": "纟",
    "⺱": "罓", "⺲": "罒", "⺹": "耂", "⺺": "肀", "⺻": "聿", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠",
    "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页",
    "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉",
    "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀", "⻳": "龟",
}
