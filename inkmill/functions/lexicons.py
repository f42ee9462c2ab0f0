"""Patterns and word lists that results depend on."""

#: Unicode white space, as a regex class both the JVM and RE2 read.
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: One line with its terminator, or the rest of a text without one.
EOL = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
LINE = rf"[^{EOL}]*(?:\r\n|[{EOL}])|[^{EOL}]+"
CJK = r"[\x{4e00}-\x{9fa5}]"

# Noise lines.
CORRUPT = r"[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]"
DIVIDER = r"^[-=_*~]{4,}$"
PLATFORM = r"(?i)^(?:PS|作者有话说|作者说|求月票|求推荐|求收藏|求订阅|月票|推荐票|加更|打赏|感谢|盟主|舵主|堂主|打赏补更|起点中文网|17K|纵横|晋江|番茄)[：: -]"
NAVIGATION = r"(?i)^(?:最新章节|加入书签|投票推荐|上一章|下一章|返回目录|章节目录|本章完|全文完|（全书完）|\(全书完\))"
LINK = rf"(?i)https?://[^{WS}]|www\.[^{WS}]|bbs\.[^{WS}]"
NOTE_WORDS = ["PS", "作者", "票", "打赏"]

# Headings.
NUMERALS = "0-9零一二两三四五六七八九十百千万"
HEADING = rf"^(?:第[{NUMERALS}]+[章节回折篇]|序章|楔子|尾声|终章|番外[{NUMERALS}]*)(?:[{WS}:：].*)?$|^(?i:Chapter|ACT|Volume|Book)[{WS}]+(?i:[0-9IVXLCDM]+)(?:[{WS}:：].*)?$"

# Style counts.
SENTENCE = r"[。！？\n]"
SCENE_TIME = r"次日|数日后|数月后|翌日|清晨|深夜|午后|傍晚|与此同时|同一时间|另一边|转眼间|不知不觉|时光飞逝"
SCENE_MOVE = r"回到|来到|走进|离开|跨入|步入|行至|遁入|出现在"
PUNCTUATION = {"comma": "[，,]", "period": "。", "exclamation": "[！!]", "question": "[？?]", "ellipsis": r"…+|\.{3,}", "colon": "[：:]", "dash": "—+|--+"}
RHETORICAL = rf"(?:难道|岂|莫非|何必|何曾|怎能|何尝){CJK}{{1,25}}[？?]"
PARALLEL = rf"(?:{CJK}{{2,6}}[，、]){{2,}}{CJK}{{2,6}}[。！？]"
THIRD, FIRST, FIRST_WORDS = "他她它", "我俺咱", ["在下", "老子"]
ACTION_CHARS = "走跑跳冲杀斩拔握拍击退进闪跨劈砸刺踏抓挥甩跃撕咬探震掠飞拿放站坐推拉拖抱跪爬举压踢挡"
ACTION_WORDS = ["点头", "摇头", "转身", "回头", "伸手", "抬头", "低头", "起身"]
MENTAL_CHARS = "想"
MENTAL_WORDS = "思索 暗想 心想 暗道 回忆 琢磨 沉思 惊疑 犹疑 盘算 察觉 感受 领会 明白 恍然 不解 暗忖 料定 震惊 骇然 觉得 认为 猜到 疑惑 迟疑 犹豫 心念 暗自 寻思".split()
SCENERY_CHARS = "风雨雷云雾光影山水林石树月日星夜殿阁峰海江河天地寒热冷暖"

# Similes.
SIMILE_MARKERS = "宛如 宛若 犹如 如同 恰似 恍若 恍如 仿若 好似 就像 像是 仿佛 恰如 浑如 似的".split()
NOT_LIKE = "不像|哪里像|怎么像|谁像"
RU_BEFORE, RU_AFTER = "不譬例诸无比", "果何是此例下上前今后今同实愿期次许旧常初二了着过说"
RU_ONE = "日贯体味致般律成"
XIANG_BEFORE = "不好图摄录影偶神活"

# Low-level measures.
LOW_SENTENCE = "[。！？!?…]+"
CLAUSE = "[，；：、,;:]"
SUBORDINATE = "因为|所以|虽然|但是|如果|那么|既然|因此|然而|不过|只是|只有|除非"
COORDINATE = "和|与|而且|或者|还是|但|而"
POSITIVE = (
    "笑 喜悦 欢喜 高兴 开心 快乐 幸福 温暖 温柔 甜蜜 希望 光明 美好 美丽 善良 感动 感激 骄傲 得意 欣慰 "
    "安心 平静 宁静 放松 舒畅 兴奋 激动 愉快 欢快 柔和 亮堂 鲜亮 晴朗 芬芳 舒展 坚定 勇气 勇敢 胜利 圆满"
).split()
NEGATIVE = (
    "哭 悲 悲伤 悲痛 痛苦 苦涩 绝望 黑暗 阴暗 恐惧 害怕 惊恐 愤怒 恼火 仇恨 厌恶 恶心 孤独 寂寞 凄凉 "
    "寒冷 冰冷 死 死亡 血 伤口 疼痛 颤抖 崩溃 疲惫 憔悴 惨 哀 愁 恨 怒 慌 惧 泪 无助"
).split()
SYSTEM_WORDS = "选项 系统 御兽 修炼 技能 等级 属性 任务 副本 天赋".split()

# Dialogue.
QUOTE = '[“"「][^”"」]*[”"」]'
SPEECH_TAGS = (
    "道 说 问 答 喊 笑 喝 叹 骂 吼 嘟囔 嘀咕 自语 心道 沉吟 冷笑 轻语 怒吼 低语 轻声 点头 摇头 皱眉 抱拳 拱手 呵斥 "
    "赞道 叹道 笑道 怒道 奇道 喜道 喝道 骂道 叫道 问道 答道 说道 嗔道 冷声道 淡笑道 沉声道 失声道 惊呼道 喃喃道 大喝道 娇笑道 冷笑道"
).split()
NO_TAGS = (
    "写道 报道 知道 味道 管道 频道 古道 王道 霸道 地道 公道 索道 门道 大道 通道 世道 乐道 头头是道 微不足道 津津乐道 瞎说 胡说 "
    "传说 听听说说 解说 评说 小说 话说 按理说 一般来说 虽说 假说 学说 听说 可说 不用说 别说 好说 难说 明说 细说 直说"
).split()
NO_NAMES = (
    "黄河 长江 泰山 昆仑 华山 嵩山 衡山 恒山 终南山 街道 广场 房间 大殿 密室 森林 湖泊 山谷 洞穴 城市 城门 窗外 门外 虚空 苍穹 "
    "天地 四周 远处 附近 身后 眼前 背后 空中 地下 水底 深渊 汽车 飞机 火车 手机 电脑 宝剑 长枪 战刀 铠甲 戒指 玉佩 灵草 "
    "丹药 石头 木头 茶杯 桌子 椅子 狂风 暴雨 闪电 雷霆 光芒 黑夜 这个 那个 一个 几个 很多 所有 一切 他们 她们 它们 我们 你们 "
    "自己 有人 谁也 谁都 何人 为何 众人 大家 属下 在下 老夫 弟子 后者 前者 对方 此人 来人 那人 这人 两人 三人 四人 "
    "毫无疑 毫无 显然 当然 总之 此时 随即 于是 接着 然后 最后 另外 此外 同时 事实上 实际上 要知道 不得不说 可以说"
).split()
NAME_STOPS = "的了吗是在有和就个也这那都很到上过得着"
ADVERBS = (
    "哈哈大笑 微微一笑 沉吟片刻 沉默片刻 深吸一口气 斩钉截铁 毫不犹豫 开门见山 胸有成竹 不动声色 若无其事 一本正经 郑重其事 想了想 想了下 "
    "点了点头 点了点 点点头 摇了摇头 摇摇头 顿了顿 笑了笑 叹了口气 松了口气 皱着眉头 挑了挑眉 无奈 严肃 认真 平静 淡定 冷静 沉重 凝重 诚恳 "
    "关切 关心 好奇 疑惑 诧异 惊讶 震惊 愤怒 恼怒 不满 失望 欣慰 得意 兴奋 激动 紧张 焦急 忧虑 迟疑 犹豫 坚决 果断 连忙 急忙 赶忙 慌忙 立即 "
    "立刻 马上 随即 忽然 突然 渐渐 缓缓 慢慢 轻轻 淡淡 微微 低声 轻声 沉声 冷声 厉声 高声 大声 朗声 柔声 小声 开口 继续 接着 然后 最后 再次 依旧 仍然"
).split()
VERB_TAILS = (
    "冷笑 大笑 微笑 苦笑 惨笑 狂笑 淡笑 沉吟 点头 摇头 皱眉 喃喃 嘀咕 嘟囔 轻声 低声 高声 沉声 厉声 缓缓 自语 沉思 怒喝 大喝 "
    "叹道 笑道 怒道 问道 答道 说道 喝道 叫道 喊道 吩咐 打断 反问 回答 追问 接口 接话 附和 安慰 催促 摊手 挑眉 撇嘴 咬牙 "
    "并 却 便 只 又 也 忙 写 心 暗 微 应 接 挑 抬 耸 摊 咧 抿 撇 瞪 怒 喜 苦 叹 惊 急 问 答 回 想 点 摇 笑 摆 说 道"
).split()
FUNCTIONS = [
    ("冲突对抗", "住手|休想|滚|该死|退下|放肆|闭嘴|给我|找死"),
    ("情感表达", "爱你|恨你|想你|抱歉|对不起|谢谢你|舍不得|心疼"),
    ("信息交换", "为何|何故|如何|什么|是否|难道|莫非|因为|所以"),
    ("日常闲聊", "吃过|天气|走吧|好吧|罢了|哈哈"),
]

# Periods of a book.
ERAS = ["开头 (Begin)", "发展 (Develop)", "成熟 (Mature)", "演变 (Evolve)", "结尾 (Ending)"]
ERA_CHOICE = {1: [0], 2: [0, 4], 3: [0, 2, 4], 4: [0, 1, 3, 4], 5: [0, 1, 2, 3, 4]}
ERA_SHARES = [0.15, 0.40, 0.65, 0.85]

# Anchors.
TAG_FRONT = "(?:说道|问道|答道|笑道|摇头|点头|回答|开口|说|道)[，：]?[“「『]"
TAG_REAR = rf"[”」』][，。！？…]?[^{WS}]{{0,40}}(?:说道|问道|答道|笑道|说|道)"
EXAMPLE = "比如说|例如|譬如"
DIALOGUE_LINE = "[“”「」『』\"']|说道|问道|答道|笑道|说|道|问|答"
FUNCTION_WORD = "[的地得了着在和与]"

# Tags that decorate a quotation.
DECORATIVE = "低声道 沉声道 冷笑道 娇笑道 幽幽地".split()

# What a card may promise, as (term in the card, mark in a quote), and how speech and comparisons show.
PROMISED_MARKS = {"ellipsis": ("省略号", "……"), "dash": ("破折号", "——"), "exclamation": ("感叹号", "！"), "question": ("问号", "？")}
SPEECH_TERMS = ["对话", "对白", "标签", "说话人", "引语", "口吻"]
COMPARISON_TERMS = ["比喻", "喻"]
SPEECH_SHOWN = "[“”「」『』\"']|说道|问道|答道|笑道|说|道|问|答"
COMPARISON_SHOWN = "宛如|犹如|如同|仿佛|像|如|若"

# Names and triggers that say nothing.
STOCK_NAMES = ["描写细腻", "文笔优美", "情节紧凑", "未命名技法"]
STOCK_TRIGGERS = ["需要时", "合适的时候", "看情况"]

# Lines that part the scenes of a trial, and the words that tell a scene's type.
SCENE_MARK = r"(?m)^[ \t\x{3000}]*(?:-{3,}|={3,}|#{1,6}[ \t\x{3000}]*场景[^\n]*)[ \t\x{3000}\r]*$"
SCENE_TYPES = [("日常", ["日常", "互动", "探索"]), ("冲突", ["冲突", "打斗", "高压", "战斗"]), ("抉择", ["抉择", "危机", "关键", "决定"])]

# Kinds of cards, as (kind, terms in the card, marks in a text); the first kind that matches counts.
CARD_PROFILES = [
    ("metaphor", ["比喻", "点染", "喻体"], ["宛若", "仿佛", "如同", "犹如", "像", "如"]),
    ("action", ["动作", "推拉", "切分", "动词"], ["拔", "斩", "冲", "退", "出拳", "踏", "抓", "挥"]),
    ("question", ["设问", "线索", "疑问", "反问"], ["难道", "为何", "究竟", "？", "?"]),
    ("ellipsis", ["省略号", "悬置"], ["……", "..."]),
    ("dash", ["破折号", "揭底"], ["——", "--"]),
    ("dialogue_tag", ["对话标签", "标签", "说话人", "对白", "台词", "声纹", "口癖"], ["说道", "问道", "答道", "笑道", "说", "道", "问", "“", "”", "「", "」"]),
    ("perspective", ["视角", "人称", "镜头", "景别", "限知", "全知"], ["他", "她", "我", "你"]),
    ("rhythm", ["节奏", "段落", "换行", "收束", "转场", "留白", "悬念", "节拍"], []),
]

# Terms in title brackets, and words that are no identity.
BRACKETED = r"《([\x{4e00}-\x{9fa5}A-Za-z0-9]{2,12})》"
NO_IDENTITY = "道 说 问 答 喊 叹 笑 说道 问道 答道 一个 这个 他们 我们 自己 什么 怎么 没有 知道 主角 导师 前辈 长辈 少年 少女 老者 青年 同伴 敌人 大人 先生 姑娘 皇帝 陛下 夫人 王爷 大臣 将军".split()

# Volume headings.
VOLUME = rf"^第[{NUMERALS}]+卷(?:[{WS}:：].*)?$"

# Phrases of stock prose.
TABOO = "总而言之 综上所述 值得注意的是 由此可见 也就是说 我们可以看到 从这个角度来看 需要指出的是 值得一提的是 必须承认的是".split()
UNPLACED = "未分期"

# Registered measures of a text, as (id, name, unit, column).
METRICS = [
    ("M001", "total_chars", "chars", "total_chars"), ("M010", "avg_sent_len", "chars", "avg"), ("M012", "short_sent_ratio_pct", "%", "short"), ("M021", "short_para_ratio_pct", "%", "short_para"),
    ("M030", "dialogue_ratio_pct", "%", "quoted_pct"), ("M042", "punc_exclamation", "/kchars", "excl"), ("M043", "punc_question", "/kchars", "ques"), ("M044", "punc_ellipsis", "/kchars", "ell"), ("M045", "punc_dash", "/kchars", "dash"),
    ("M060", "metaphor_density", "/kchars", "simile"), ("M070", "action_mental_ratio", "ratio", "act_per_mind"), ("M091", "ttr_filtered", "ratio", "ttr"), ("M096", "sentiment_balance", "ratio", "balance"),
]
PLACEHOLDER = r"\{\{(?:metric:([A-Z]\d+)\|)?([a-z_]+)\}\}"

# Names that labels may use, first match counts.
METRIC_ALIASES = [
    ("avg_sent_len", ["平均句长", "句长"]), ("median_sent_len", ["中位句长"]), ("short_sent_ratio", ["短句率", "短句占比"]), ("long_sent_ratio", ["长句率", "长句占比"]), ("avg_para_len", ["平均段长", "段落长度"]),
    ("short_para_ratio", ["极短段率", "短段率"]), ("dialogue_ratio", ["对话占比", "对话比例", "对话率"]), ("dao_shuo_ratio", ["道说比", "道:说"]), ("tag_frequencies", ["标签频次", "对话标签"]), ("punc_exclamation", ["感叹号"]),
    ("punc_question", ["问号"]), ("punc_ellipsis", ["省略号"]), ("punc_dash", ["破折号"]), ("comma_period_ratio", ["逗句比", "逗号句号比"]), ("metaphor_density", ["比喻"]), ("rhetorical_question_density", ["反问"]), ("parallelism_density", ["排比"]),
    ("pov_pronouns", ["视角", "人称代词", "第一人称", "第三人称"]), ("description_density", ["描写密度", "动作心理比", "环境描写", "action_mental_ratio", "action_count", "env_count", "mental_count"]), ("imagery_clusters", ["意象", "高频词"]),
]

# How reports write measures, as (name, pattern with the number, kind of tolerance, tolerance), and those that must be right.
AUDIT_RULES = [
    ("dialogue_ratio_pct", r"(?:对话字符占比|对话占比|对话比例)[^。；\n]{0,10}?(\d+(?:\.\d+)?)\s*%", "rel", 0.06),
    ("avg_sent_len", r"平均句长[^。；\n\d]{0,8}(\d+(?:\.\d+)?)\s*字", "abs", 1.5),
    ("short_sent_ratio_pct", r"短句率[^。；\n]{0,12}?(\d+(?:\.\d+)?)\s*%", "rel", 0.08),
    ("short_para_ratio_pct", r"极短段率?[^。；\n]{0,12}?(\d+(?:\.\d+)?)\s*%", "rel", 0.08),
    ("metaphor_density", r"比喻(?:句)?密度[^。；\n\d]{0,6}(\d+(?:\.\d+)?)\s*(?:次)?\s*/?\s*千字", "rel", 0.08),
    ("punc_exclamation", r"感叹号密度[^。；\n\d]{0,6}(\d+(?:\.\d+)?)", "rel", 0.08),
    ("punc_question", r"问号密度[^。；\n\d]{0,6}(\d+(?:\.\d+)?)", "rel", 0.08),
    ("punc_ellipsis", r"省略号密度[^。；\n\d]{0,6}(\d+(?:\.\d+)?)", "rel", 0.08),
    ("punc_dash", r"破折号密度[^。；\n\d]{0,6}(\d+(?:\.\d+)?)", "rel", 0.08),
    ("action_mental_ratio", r"动作[:：/]?(?:心理|与心理)比[^。；\n\d]{0,6}(\d+(?:\.\d+)?)", "rel", 0.08),
    ("total_chars", r"(?:总字符数|总字符|字符总数)[^。；\n\d]{0,6}?(\d[\d,]*)\s*(?:字符|字)", "rel", 0.02),
    ("ttr_filtered", r"(?:过滤后TTR|实词丰富度)[^。；\n\d]{0,6}(\d+(?:\.\d+)?)", "rel", 0.20),
    ("sentiment_balance", r"情感(?:平衡|倾向)值[^。；\n\d\-]{0,6}(-?\d+(?:\.\d+)?)", "abs", 0.25),
]
CORE_METRICS = ["avg_sent_len", "dialogue_ratio_pct", "short_sent_ratio_pct", "metaphor_density", "action_mental_ratio"]

# The parts of a report.
REPORT_PARTS = ["第〇部分", "第一部分", "第二部分", "第三部分"]
