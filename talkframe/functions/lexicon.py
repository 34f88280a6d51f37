"""Word lists, patterns and limits that decide results. Everything here is a parameter of some operator."""

from __future__ import annotations

# Results depend on them as they stand.

SESSION_GAP_MINUTES = 30

CONFLICT_WORDS = (
    "吵", "生气", "不理", "分手", "烦", "算了", "随便", "别说了", "冷战", "道歉", "对不起", "后悔",
    "别跟我", "你发消息就是", "没催", "别催", "改期", "正经点", "行吧", "就这", "不想说", "没打算", "你又", "每次都",
)
STOP_PHRASES = (
    "哈哈", "哈哈哈", "嗯嗯", "哦哦", "好的", "在的", "然后", "就是", "什么", "怎么", "可以", "没有", "不是", "我们", "你们", "他们",
    "哈哈哈哈哈", "这个", "那个", "现在", "已经", "还是", "真的",
)
SENTENCE_SPLIT = r"[。！？!?~～\.,，、\s]+"
CLAUSE_SPLIT = r"[\s，,。.!！?？;；]+"
EMOJI = r"\[[^\[\]]{1,8}\]"
QUESTION_ENDS = ("?", "？", "吗", "呢", "吧")
SENTENCE_ENDS = "。！？!?…~～"
TONE_PARTICLES = ("啊", "吧", "呢", "哦", "喔", "呀", "嘛", "咯", "哇", "嘿", "唉", "诶", "咦", "嗯", "哈", "啦", "嘞", "哟", "嗷", "呜")
LAUGH_WORDS = ("笑死我了", "笑死", "哈哈", "嘿嘿", "嘻嘻", "呵呵", "hhh", "2333", "233", "emmm")
POSITIVE_WORDS = (
    "超级喜欢", "好喜欢你", "开心", "高兴", "幸福", "喜欢", "爱你", "想你", "想你啦", "想你了", "好棒", "厉害", "可爱", "心疼", "谢谢", "辛苦",
    "放心", "抱抱", "亲亲", "么么", "宝贝", "乖乖", "乖", "甜的", "好甜", "真好", "太棒", "太好了", "嘿嘿", "棒", "赞", "乖啦",
    "不错", "挺好", "没问题", "好事", "稳了", "可以啊", "辛苦了", "感谢", "靠谱",
)
NEGATIVE_WORDS = (
    "气死", "烦死", "无语", "难受", "委屈", "伤心", "难过", "生气", "讨厌", "崩溃", "不想理", "别理我", "算了", "随便", "别说了", "冷战", "分手",
    "吵架", "对不起", "道歉", "后悔", "孤独", "想哭", "烦", "累", "唉", "烦人", "受不了", "没意思",
)
LOW_MOOD_WORDS = ("唉", "不开心", "难过", "委屈", "没意思", "想哭", "孤独", "难受", "烦", "算了", "不想", "累了")
CARE_WORDS = (
    "早点睡", "早点休息", "注意身体", "注意安全", "多喝热水", "记得吃饭", "吃饭了吗", "吃了吗", "别熬夜", "别累着", "照顾好自己", "路上小心",
    "带伞", "多穿", "别感冒", "小心点", "别忘了", "到家了", "到家", "睡了吗",
)
PET_NAMES = (
    "宝贝", "宝宝", "老婆", "老公", "亲爱的", "亲爱的", "笨蛋", "傻子", "蠢货", "憨憨", "狗子", "猪猪", "小可爱", "崽崽", "小猪", "大宝", "乖乖", "臭宝",
)
DIRECT_WORDS = ("想你", "好想你", "喜欢你", "爱你", "抱抱", "亲亲", "么么", "离不开你")
SAID_DIRECTLY = ("想你", "喜欢你", "爱你", "好想你")
SWEET_WORDS = ("说定了", "说定", "约定", "答应", "我跟你", "跟你组", "一起", "等我", "下次还来", "下次叫你", "真的", "稳了", "值了", "晚安", "谢了", "请你", "请我")
PEACE_WORDS = ("对不起", "抱歉", "别生气", "好啦", "抱抱", "亲亲", "嗯嗯", "没事", "算了", "行", "好了")
SAMPLE_CONFLICT = ("生气", "别催", "别跟我", "吵架", "冷战", "对不起")
SAMPLE_PLAN = ("要不要", "一起", "说定", "周末")
RELATION_SIGNALS = {
    "恋人": ("想你", "喜欢你", "爱你", "宝贝", "宝宝", "抱抱", "亲亲", "么么", "老公", "老婆", "亲爱的", "约会", "牵手", "异地", "想我"),
    "家人": ("爸", "妈", "爷爷", "奶奶", "姥姥", "外公", "外婆", "哥", "姐", "弟", "妹", "家里", "过年", "压岁钱", "回家"),
    "同事": (
        "项目", "需求", "排期", "上线", "汇报", "会议", "客户", "甲方", "领导", "同事", "面试", "方案", "代码", "排针", "物料", "生产", "实习", "培训",
        "实验室", "开发", "测试", "文档", "汇报", "任务",
    ),
}
RELATION_MIN_DENSITY = 1.0
DEFAULT_RELATION = "朋友"
GENERIC_WORDS = (
    "我们", "你们", "他们", "这个", "那个", "什么", "怎么", "可以", "没有", "不是", "现在", "已经", "还是", "真的", "就是", "然后", "因为", "所以", "但是", "如果",
    "一样", "一点", "有点", "时候", "知道", "觉得", "可能", "应该", "今天", "明天", "昨天", "晚上", "早上", "下午", "一下", "一个", "这里", "那里", "自己", "别人",
    "事情", "问题", "东西", "地方", "时间", "感觉", "有点", "不太", "好像", "反正",
    "我今天", "我昨天", "我明天", "我前天", "你说", "我说", "他说", "她说", "你想", "我想", "你在", "我在", "我知道", "我不知道", "你不知道", "我觉得", "我是不是",
    "你是不是", "你能", "我能", "你会", "我会", "你要", "我要", "你在干嘛", "在干嘛",
)
PLACE = r"[\x{4e00}-\x{9fa5}A-Za-z0-9]{1,4}(?:省|市|区|县|镇|村|街道|路|街|巷|站|机场|火车站|地铁|公园|广场|学校|大学|医院|餐厅|饭店|酒店|超市|商场|电影院|图书馆|楼下|门口)"
PLACE_AFTER_VERB = r"(?:去|到|在|逛)(?:了|过)?([\x{4e00}-\x{9fa5}A-Za-z0-9]{2,8})"
PLACE_SUFFIXES = "省市区县镇村街路巷站楼场园校院馆店厦房寓"
PLACE_ORAL = ("宿舍", "食堂", "教室", "操场", "后山", "图书馆", "食堂二楼", "山脚", "宿舍楼")
PLACE_LEAD_TRIM = "等下去了到在逛还就也又都再这那我你他她的是很太"
PLACE_STOPS = "了好不要没想会能是我你他她它这那什么怎么吗呢吧啊呀哦嘛啦的吃喝睡玩买说看做走来回给让把被和跟对太很都还也就只再又真挺蛮超特，,。！!？?、；;：:（）()　 \t\n"
PLACE_BLOCKLIST = ("吃饭", "睡觉", "上班", "下班", "上课", "玩", "看剧", "逛街", "洗澡", "干嘛", "哪里", "这里", "那里", "厕所", "一下", "哪儿")
CALL_BY_NAME = r"(?:叫|喊|称呼)(?:你|我|他|她|TA|ta)?\s*[「『\"'“‘]?([\x{4e00}-\x{9fa5}A-Za-z0-9]{1,6})[」』\"'”’]?"
CALL_BY_AT = r"@([\x{4e00}-\x{9fa5}A-Za-z0-9_\-]{1,12})"
EXPRESSIVE = r"我|你|别|不|好|真|太|就|还|下次|一定|行|算|牛|擦|[啊吧呢哦呀嘛嘿唉嗯哈啦]|笑|谢|靠|艹|卧槽"
MEDIA_KINDS = "图片|照片|表情|语音|视频|文件|链接|位置|动画表情|回复消息|合并转发|转账|红包"
MEDIA_PLACEHOLDER = r"\[(?:图片|照片|表情|语音|视频|文件|链接|动画表情|位置|转账|红包|撤回|系统提示|回复消息|合并转发|引用|图片消息|语音消息)\]"
UNRESOLVED_REPLY = r"\[\s*(?:回复消息|引用消息|引用回复)(?:\s*[:：][^\]]*)?\s*\]"
#: (label, pattern of what came in, pattern of the reply, what the reply does), first match counts.
SITUATIONS = (
    (
        "被指出说法或承诺有问题",
        r"你(?:上次|上周|之前|刚才|那天|刚刚|不是|明明|曾经).{0,10}(?:说|答应|承诺)|你说的.{0,8}(?:不对|不是|错|矛盾)|(?:不是|明明)说(?:好|过)|说好的"
        r"|说好.{0,12}(?:呢|怎么|咋|没|不)|放鸽子|又鸽|你.{0,6}(?:改口|食言|反悔)|(?:说法|承诺).{0,6}(?:不对|有问题|变了)|^[^，。！？\s]{1,10}那次[?？!！。]*$",
        r"那叫|这叫|那是|这周|准确|不是.{0,8}是",
        "抓住对方说法中的一点，短句修正或换个说法接回去",
    ),
    ("被催或被提醒", r"催|写|交|报告|做完|弄完|忘|截止", r"别催|别跟我|你发消息|催|等会|等下|知道了|别急", "先回应催促本身，再按当前进度接话；保留原话里的顶嘴或缓冲语气"),
    ("对方表达感谢", r"谢|多亏|要不是你|帮大忙", r"请我|请客|欠我|喝水|喝奶茶|不客气|没事|应该的|小事", "用原话里的回礼要求或简短答语接住感谢"),
    ("对方抱怨没被叫上", r"不叫我|没叫我|不带我|没带我", r"下次|叫你|带你|忘了|抱歉", "顺着抱怨回应下一次的安排，用短句补一句承诺"),
    ("对方要求正经一点", r"正经|认真|别闹|别逗", r"正经|认真|就是|明明", "沿着刚才的话题继续接梗，保留原话中一本正经的措辞"),
    ("对方给出答应或确认", r"真的|行$|可以|好$|答应|没问题|我跟你|说定", r"说定|约定|那就|等你|等我|记住|稳了", "把对方的确认接成具体约定或下一步"),
    ("对方报告进度或结果", r"通过|好了|完成|成功|起了|到了|发了|报名", r"收到|好|等会|我也|我已经|骑车|送你|恭喜", "接上对方的进度，报自己的状态或给一个下一步"),
)
EVERYDAY = "日常接话"
SCENARIO_IDS = {
    "对方表达感谢": "thanks-reciprocity", "被催或被提醒": "being-reminded", "被指出说法或承诺有问题": "correction-or-promise", "对方抱怨没被叫上": "left-out-complaint",
    "对方要求正经一点": "asked-to-be-serious", "对方给出答应或确认": "confirmation", "对方报告进度或结果": "progress-or-result", "日常接话": "everyday-chat",
}
SIGNAL_TOKEN = r"[\x{4e00}-\x{9fff}]{2,8}|[A-Za-z][A-Za-z0-9_-]{2,}"
SIGNAL_STOP = ("然后", "这个", "那个", "真的", "现在", "已经", "不是", "可以", "什么", "怎么", "我们", "你们", "哈哈", "一下", "一下子", "事情", "知道", "感觉")
UNIQUE_STOP = ("知道", "现在", "已经", "这个", "那个", "真的", "我们", "你们", "然后", "什么")
RETRIEVAL_STOP = ("现在", "这个", "那个", "我们", "你们", "什么", "怎么", "知道", "真的")
DISTRESS = r"很难过|真的难受|不想活|崩溃|别开玩笑|认真说|不是开玩笑"
GENERIC_CLAIM = r"幽默|风趣|嘴硬心软|说话自然|关心对方|善解人意|活泼开朗|温柔体贴|表达简洁|自然随性|很有个性|性格很好|比较外向|比较内向|喜欢聊天|情商高|人很好"
UNCERTAIN_WORDS = ("不确定", "不一定", "可能", "好像", "似乎", "保证不了", "不能保证", "没法保证")
PROMISE_WORDS = ("答应", "保证", "一定", "承诺")
PLAN_WORDS = ("下次", "改天", "以后", "说定", "打算", "计划", "准备", "约好")
DONE_WORDS = ("刚到", "已经到", "去了", "去过", "完成了", "交了", "成功了")
NEGATIONS = ("不", "没", "未", "别")
CONFLICT_MARKS = ("不", "没", "未", "取消", "改了", "不再")
CONFLICT_STOP_GRAMS = ("已经", "下次", "可能", "没有", "原话")
MEMORY_KINDS = {"关系时间线": "fact", "一起去过的地方": "fact", "inside_jokes": "joke", "争吵模式": "fact", "甜蜜瞬间": "fact", "称呼与专属用语": "mentioned"}
#: (pattern, tag), in this order.
REDACTIONS = (
    (r"1[3-9]\d{9}", "[手机号]"),
    (r"\b\d{17}[\dXx]\b", "[身份证]"),
    (r"\b\d{16,19}\b", "[卡号]"),
    (r"[\w.+-]+@[\w-]+\.[\w.]+", "[邮箱]"),
    (r"(?:[\x{4e00}-\x{9fa5}]{2,8}(?:省|市|区|县|镇|街道|小区|大厦|公寓)){2,}", "[详细地址]"),
)
DEIXIS = ("咱俩", "咱们", "我们俩", "你我", "跟你说过", "我跟你", "你上次", "我上次", "上次说", "上次那个", "上回", "那次", "你还记得", "记得吗", "你之前说", "我之前说")
DEIXIS_MARK = "（公开版需确认：这里的指代只有本人对得上）"
#: (category, pattern, severity, suggestion)
PRIVACY_RULES = (
    ("phone", r"(?<!\d)1[3-9]\d{9}(?!\d)", "high", "手机号可能未脱敏"),
    ("email", r"[\w.+-]+@[\w-]+\.[\w.]+", "high", "邮箱可能未脱敏"),
    ("id_or_card", r"(?<!\d)(?:\d{17}[\dXx]|\d{16,19})(?!\d)", "high", "身份证或银行卡号可能未脱敏"),
    ("private_deixis", "|".join(DEIXIS), "medium", "包含只对本人有意义的私密指代"),
    ("location", r"(?:[\x{4e00}-\x{9fff}]{2,12})(?:省|市|区|县|镇|街道|路|号|宿舍|学校|公司|医院)", "medium", "包含地点、单位或地址线索"),
)
QUOTE = r"[「『“\"]([^「」『』“”\"]{2,120})[」』”\"]"
YEAR_MONTH = r"(\d{4})\s*[-/年.]\s*(\d{1,2})"
MONTH_DAY = r"(?<!\d)(\d{1,2})\s*月\s*(\d{1,2})\s*[日号]"
CITE_ARROW = r"\s*(?:←|<-|<—|<=|⇐)\s*"
FUZZY_THRESHOLD = 0.75
CITE_THRESHOLD = 0.9
CANDIDATE_LINES = 24
VERBATIM_SECTIONS = ("典型例句",)
UNQUOTED_SECTIONS = ("硬规则", "温度与分寸", "统计画像")
EVIDENCE_SECTION = "依据"
SYSTEM_SPEAKER = "系统消息"
SYSTEM_TYPE = "系统"
UNKNOWN_SPEAKER = "未知"
SELF_SPEAKER = "我"
OTHER_SPEAKER = "对方"
BANNER_STARTS = ("消息记录", "消息分组", "消息对象", "===========")


# Fixed values of review, evaluation and packing.

SERVICE_PHRASES = ("您好", "不客气", "很高兴能帮助", "请问还有什么", "感谢您的理解", "作为 AI")
FEEDBACK_LABELS = ("像本人", "太客气", "答非所问", "场景用错", "事实错误", "其他")
CORRECTIONS = {
    "太客气": "减少客套与服务式收尾，按该场景的原话语气接话",
    "答非所问": "先回应眼前的问题，不让旧示范带走当前话题",
    "场景用错": "重新判断当前情绪与意图；仅在相似语境下参考该接法",
    "事实错误": "不要复述未经当前对话确认的经历、地点或承诺，记不清就承认",
}
GENERIC_ITEM = r"^(?:性格|风格|特点|TA)?[：: ]*(?:幽默风趣|嘴硬心软|说话自然|关心对方|善解人意|活泼开朗|温柔体贴|表达简洁|自然随性)[。！! ]*$"
TIMING_RULE = r"秒回|隔.*(?:分钟|小时).*回|回消息(?:快|慢)|夜里更活跃|深夜型"
ABSOLUTE_RULE = r"从不|永不|绝不|一律不"
ABSOLUTE_ABOUT = r"表情|亲昵|肉麻|关心|直球"
REPORT_LINE = r"^(?:消息长度：|标点：|作息：|情绪基调：|表达频率：|回复速度：|主动性：|话量：|篇幅对称：|亲密度\s*\d|冷热节奏：)"
QUOTED = r"[「『“\"]([^「」『』“”\"]+)[」』”\"]"
QUOTED_PAIR = r"对方\s*[:：]\s*((?:[「『“\"][^「」『』“”\"]+[」』”\"]\s*)+)(?:→|->|⇒)\s*(?:我|TA)\s*[:：]\s*((?:[「『“\"][^「」『』“”\"]+[」』”\"]\s*)+)"
SECTION_LIMITS = {"人物特点": 4, "情境策略": 6, "口头禅": 12, "典型例句": 8, "接话方式": 8}
UNTIMED_MONTH = "未标时间"
UNTIMED = "（无时间）"
PACK_BUDGET_BYTES = 8 * 1024 * 1024

# Section titles by relation, in the order of MEMORY_KINDS.
SECTION_TITLES = {
    "恋人": ("关系时间线", "一起去过的地方", "inside jokes", "争吵模式", "甜蜜瞬间", "称呼与专属用语"),
    "朋友": ("认识与相处时间线", "一起去过的地方", "inside jokes", "闹别扭的时候", "相处高光", "互相怎么称呼"),
    "同事": ("共事时间线", "一起去过 / 提到的地方", "你们之间的固定说法", "分歧与摩擦", "配合默契的瞬间", "互相怎么称呼"),
    "家人": ("关系时间线", "一起去过的地方", "家里的梗", "争执模式", "温暖瞬间", "称呼与专属用语"),
}

# Fixed values of citations and pages.

#: Before a quoted claim: a bracket, a date or time, a name with its colon.
CITED_BRACKET = r"[\[【][^\]】]{0,32}[\]】]"
CITED_STAMP = r"\d{1,4}[\d\-/.月日:：]{0,18}"
CITED_NAME = r"([^\s:：]{1,20})\s*[:：]\s*"
CLAIM_BREAK = r"[\s,，:：]+"
#: Tags that end a line.
BLOCK_TAGS = frozenset(("br", "p", "div", "tr", "li", "h1", "h2", "h3", "h4", "td", "table"))
#: Heading of a sampled window, and what stands for a missing time or month.
SAMPLE_HEADING = "【会话 {session} / 窗口 {window}；与其他会话独立】"
SAMPLE_UNTIMED, SAMPLE_NO_MONTH = "[时间未知]", "未知"
SCENE_CONFLICT, SCENE_PLAN, SCENE_EVERYDAY = "摩擦", "商量", "日常"
#: Off a sampled window for each one chosen before of its month, scene and session.
SAMPLE_PENALTIES = (3, 3, 4)

# Fixed values of documents and states.

SOURCE_CAP_BYTES = 50 * 1024 * 1024
TOPICS_TITLE, EVIDENCE_TITLE, GUIDE_TITLE = "# 主题档案", "# 结论与原文依据", "# 参考资料"
COVERAGE_TITLE, SPECIFICITY_TITLE = "## 情境覆盖矩阵", "## 具体性评分"
EVIDENCE_MARKS = {"verified": "原话命中", "fuzzy": "近似命中", "unverified": "未找到依据"}
COVERAGE_LABELS = {"covered": "已覆盖", "evidence_insufficient": "证据不足", "missing_response": "缺失接法"}
STATUS_LABELS = {"fact": "事实", "plan": "计划", "promise": "承诺", "mentioned": "提及", "joke": "玩笑", "uncertain": "不确定"}
IDENTITY_GIVEN, IDENTITY_NOTICE = "用户补充（未经聊天记录核实）：{0}", "记录里没有直接的身份信息；建议用 --desc 补充职业、关系、认识方式等背景"
CURRENT_SITUATION = "【当前情境参考】"
#: Characters after which a joined line needs no blank: CJK punctuation and kana, ideographs, full-width forms.
CJK_RANGES = "　-ヿ一-鿿＀-￯"
#: Longest and shortest sides of an exchange that may serve as an example: incoming from, to; reply to; replies.
HOLDOUT_MOVE = "对照原聊天判断语气与接法"
EXAMPLE_LIMITS = (4, 28, 26, 3)
#: Marks in brackets that keep an exchange from serving as an example (fixed values).
EXAMPLE_BAD_MARKS = ("图片", "视频", "语音", "文件", "链接", "表情", "通话", "引用", "微信转账", "红包", "位置", "名片", "手机号", "身份证", "银行卡", "邮箱", "地址")
