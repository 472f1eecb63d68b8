"""Fact vocabulary of the Mandarin pack: terms with their English, units, and what joins or ends them.

All tables are fixed values in the order that decides between them.
"""

from __future__ import annotations

from dataclasses import dataclass

# The glossary; an empty rendering counts as translated.
GLOSSARY = {
    "十四五规划纲要": "14th Five-Year Plan Outline", "十五五规划纲要": "15th Five-Year Plan Outline", "实施细则": "implementing rules", "实施方案": "implementation plan",
    "行动计划": "action plan", "试点方案": "pilot scheme", "管理办法": "management measures", "暂行办法": "interim measures", "配套办法": "supporting measures",
    "指导意见": "guiding opinion", "实施意见": "implementing opinion", "负面清单": "negative list", "白皮书": "white paper", "办法": "measures", "条例": "regulation",
    "通知": "notice", "公告": "announcement", "规定": "provisions", "意见": "opinion", "目录": "catalogue", "清单": "list", "纲要": "outline", "规划": "plan",
    "新能源汽车": "new-energy vehicles", "动力电池": "power batteries", "锂电池": "lithium batteries", "充电桩": "charging piles", "集成电路": "integrated circuits",
    "半导体": "semiconductors", "先进制程": "advanced-node manufacturing", "人工智能": "artificial intelligence", "生成式人工智能": "generative artificial intelligence",
    "大模型": "large models", "算力枢纽": "computing-power hubs", "算力": "computing power", "智算": "intelligent computing", "关键核心技术": "core technologies",
    "产业链供应链": "industrial and supply chains", "专精特新": "specialised SMEs", "中小企业": "small and medium enterprises", "制造业": "manufacturing", "房地产": "real estate",
    "保交楼": "housing-delivery guarantees", "隐性债务": "hidden local debt", "地方债": "local-government debt", "系统性金融风险": "systemic financial risk",
    "系统性风险": "systemic risk", "资本无序扩张": "disorderly capital expansion", "关键矿产": "critical minerals", "稀土": "rare earths", "菜籽油": "canola oil",
    "菜籽": "canola", "软木": "softwood", "粮食安全": "food security", "乡村振兴": "rural revitalisation", "耕地": "arable land", "粤港澳": "the Greater Bay Area",
    "长三角": "the Yangtze River Delta", "京津冀": "Beijing-Tianjin-Hebei", "东北": "Northeast China", "新疆": "Xinjiang", "西藏": "Tibet", "南海": "the South China Sea",
    "台海": "the Taiwan Strait", "两岸": "cross-Strait", "台湾": "Taiwan", "中加": "China-Canada", "加方": "the Canadian side", "加拿大": "Canada",
    "一带一路": "the Belt and Road Initiative", "军工": "the defence industry", "国防": "national defence", "演训": "training exercises", "战备": "combat readiness",
    "社会治理": "social governance", "基层治理": "grassroots governance", "共同富裕": "common prosperity", "民生": "livelihood", "舆情": "public-opinion management",
    "营商环境": "the business environment", "扩大内需": "domestic-demand expansion", "统一大市场": "the unified national market", "双循环": "dual circulation",
    "新质生产力": "new quality productive forces", "高质量发展": "high-quality development", "数据违规出境": "improper cross-border data transfers",
    "违规出境": "improper cross-border transfer", "数据出境": "cross-border data transfer", "出境": "cross-border transfer", "违规": "rule-breaking", "数据": "data",
    "骗补": "subsidy fraud", "挪用": "misappropriation", "青年": "youth", "交流": "exchange", "宣传": "publicity", "备案": "filing", "配套": "supporting", "枢纽": "hub",
    "芯片": "chips", "企业": "enterprises", "试点": "pilot", "自主可控": "self-controllable supply", "国产替代": "domestic substitution", "卡脖子": "chokepoint",
    "有关": "relevant", "相关": "related", "等": "and related", "与": "and", "和": "and", "及": "and", "或": "or", "的": "", "在": "", "上": "", "中": "",
}

# Official actions and campaigns; the first that occurs decides.
ACTIONS = {
    "接受审查调查": "is placed under disciplinary investigation", "立案审查": "is placed under formal disciplinary review", "立案侦查": "is placed under criminal investigation",
    "双开": "is expelled from the Party and public office", "开除党籍": "is expelled from the Party", "开除公职": "is dismissed from public office",
    "留党察看": "is put on internal Party probation", "党内警告": "receives a Party warning", "撤销职务": "is removed from office", "免去职务": "is removed from office",
    "正式免职": "is formally dismissed", "调任": "is transferred to a new post", "连任": "is re-elected", "当选": "is elected", "辞去职务": "resigns from office",
    "挂职": "takes a temporary posting", "任命": "is appointed", "批准逮捕": "is formally arrested", "提起公诉": "is formally prosecuted",
    "一审判决": "receives a first-instance verdict", "获刑": "is sentenced", "会见": "meets with a foreign counterpart", "会晤": "holds talks with a foreign counterpart",
    "正式访问": "pays an official visit", "成功发射": "successfully launches", "发射成功": "is successfully launched", "发射升空": "lifts off",
    "圆满成功": "is declared a full success", "首飞": "makes its maiden flight", "下水": "is launched", "交付使用": "is delivered into service",
    "正式投产": "enters production", "正式开业": "formally opens", "正式启用": "is formally activated", "揭牌": "is formally inaugurated", "正式开工": "breaks ground",
    "竣工": "is completed", "启动仪式": "holds its launch ceremony", "颁奖仪式": "holds an awards ceremony", "颁授": "confers honors", "授称": "confers honorary titles",
    "荣获": "wins", "获得": "receives", "夺得": "wins", "摘得": "takes", "论坛": "holds a forum", "网络安全周": "holds a Cybersecurity Week campaign",
    "安全生产月": "holds a Work Safety Month campaign", "宪法宣传周": "holds a Constitution Publicity Week campaign", "国家安全教育日": "marks National Security Education Day",
    "普法宣传周": "holds a Legal Awareness Week campaign", "主题教育活动": "runs a themed education campaign", "专项行动": "launches a targeted campaign",
    "巡回宣讲": "runs a touring outreach campaign", "培训班": "runs a training program", "学习班": "runs a study program", "宣传月": "holds a Publicity Month campaign",
    "宣传周": "holds a Publicity Week campaign",
}

# Bodies and meetings that act, roles that may follow one, and placeholders for one.
BODIES = {
    "中共中央办公厅": "the CPC Central Committee General Office", "国务院办公厅": "the State Council General Office", "国务院台湾事务办公室": "the Taiwan Affairs Office",
    "国台办": "the Taiwan Affairs Office", "国家发展改革委员会": "the National Development and Reform Commission", "国家发展改革委": "the National Development and Reform Commission",
    "国家发改委": "the National Development and Reform Commission", "发改委": "the National Development and Reform Commission",
    "工业和信息化部": "the Ministry of Industry and Information Technology", "工信部": "the Ministry of Industry and Information Technology",
    "科学技术部": "the Ministry of Science and Technology", "科技部": "the Ministry of Science and Technology", "商务部": "the Ministry of Commerce",
    "外交部": "the Ministry of Foreign Affairs", "财政部": "the Ministry of Finance", "教育部": "the Ministry of Education", "公安部": "the Ministry of Public Security",
    "国防部": "the Ministry of National Defense", "农业农村部": "the Ministry of Agriculture and Rural Affairs", "交通运输部": "the Ministry of Transport",
    "自然资源部": "the Ministry of Natural Resources", "生态环境部": "the Ministry of Ecology and Environment",
    "住房和城乡建设部": "the Ministry of Housing and Urban-Rural Development", "人力资源和社会保障部": "the Ministry of Human Resources and Social Security",
    "国家卫生健康委员会": "the National Health Commission", "国家卫健委": "the National Health Commission", "国家能源局": "the National Energy Administration",
    "国家市场监督管理总局": "the State Administration for Market Regulation", "市场监管总局": "the State Administration for Market Regulation",
    "国家互联网信息办公室": "the Cyberspace Administration of China", "中央网信办": "the Cyberspace Administration of China", "国家网信办": "the Cyberspace Administration of China",
    "国家税务总局": "the State Taxation Administration", "国家统计局": "the National Bureau of Statistics",
    "国家金融监督管理总局": "the National Financial Regulatory Administration", "中国证监会": "the China Securities Regulatory Commission",
    "证监会": "the China Securities Regulatory Commission", "中国人民银行": "the People's Bank of China", "人民银行": "the People's Bank of China",
    "海关总署": "the General Administration of Customs", "国务院": "the State Council", "省级人民政府": "provincial governments",
}
MEETINGS = {
    "中央经济工作会议": "the Central Economic Work Conference", "中共中央政治局": "the CPC Politburo", "中央政治局": "the CPC Politburo",
    "国务院常务会议": "the State Council executive meeting", "中央全会": "a Central Committee plenum", "全国人民代表大会": "the National People's Congress",
}
ROLES = {"新闻发言人": "spokesperson", "发言人": "spokesperson", "有关负责人": "official", "主要负责人": "senior official", "负责人": "official", "例行记者会": "regular press conference", "部长": "minister"}
UNNAMED = {
    "各地各部门": "unnamed local authorities and departments", "各级党委": "unnamed Party committees at all levels", "有关部门": "unnamed “relevant departments”",
    "有关方面": "unnamed “relevant parties”", "有关单位": "unnamed “relevant units”", "有关会议": "an unnamed meeting", "地方会议": "an unnamed local meeting",
}

# Kinds of document with their article, those that are plural, and words that end a walk to the left.
INSTRUMENTS = {
    "实施细则": "implementing rules", "实施方案": "an implementation plan", "行动计划": "an action plan", "试点方案": "a pilot scheme", "管理办法": "management measures",
    "暂行办法": "interim measures", "配套办法": "supporting measures", "指导意见": "a guiding opinion", "实施意见": "an implementing opinion", "负面清单": "a negative list",
    "白皮书": "a white paper", "办法": "measures", "条例": "a regulation", "通知": "a notice", "公告": "an announcement", "规定": "provisions", "纲要": "an outline",
}
PLURAL = ("实施细则", "管理办法", "暂行办法", "配套办法", "办法", "规定")
MODIFIER_STOPS = ("出台", "印发", "制定", "制订", "发布", "公布", "颁布", "修订", "编制", "研究", "适时", "推出", "要求", "落实", "完善")

# Money, funding and what qualifies a number.
MONEY_UNITS = {"万亿元": 10**12, "万亿": 10**12, "亿元": 10**8, "亿": 10**8, "万元": 10**4}
VEHICLES = {
    "中央预算内投资": "central budget investment", "专项债券": "special-purpose bonds", "专项资金": "special funds", "专项支持": "dedicated support", "财政资金": "fiscal funds",
    "预算安排": "budget appropriations", "财政支持": "fiscal support", "专项债": "special-purpose bonds", "贴息": "interest subsidies", "补贴": "subsidies",
    "拨款": "appropriations", "信贷": "credit", "基金": "a fund", "额度": "a quota",
}
QUALIFIERS = {
    "不少于": ("at_least", "no less than"), "不低于": ("at_least", "no less than"), "至少": ("at_least", "at least"), "不超过": ("at_most", "no more than"),
    "不高于": ("at_most", "no more than"), "最高": ("at_most", "up to"), "超过": ("more_than", "more than"), "逾": ("more_than", "more than"), "达": ("more_than", "reaching"),
    "约": ("about", "about"), "近": ("about", "nearly"),
}
QUANTITY_QUALIFIERS = ("不少于", "不低于", "至少", "不超过", "不高于", "超过", "约", "近", "达")
#: A unit that counts by ten thousand has a factor.
QUANTITIES = {
    "个百分点": (1, " percentage points"), "百分点": (1, " percentage points"), "万标箱": (10_000, " TEU"), "万千瓦": (10_000, " kW"), "万吨": (10_000, " tonnes"),
    "万辆": (10_000, " units"), "万台": (10_000, " units"), "万人": (10_000, " people"), "万家": (10_000, " firms"), "倍": (1, "-fold"), "%": (1, "%"), "％": (1, "%"),
}

# Time.
DEADLINE = r"(?:于|到|至|自|在)?((?:19|20)\d{2})\s*年(?:\s*(1[0-2]|[1-9])\s*月)?\s*(底|末)?\s*(前|以前|之前|以来|起|后)?"
RELATIVE_TIMES = {
    "本月底前": "by the end of this month", "本月底": "by the end of this month", "本年底前": "by year-end", "年底前": "by year-end", "年内": "within the year",
    "月内": "within the month", "限期": "within a set deadline", "十四五": "the 14th Five-Year Plan period (2021-2025)", "十五五": "the 15th Five-Year Plan period (2026-2030)",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# Scope, bans, subjects.
SCOPES = {
    "先行先试": "early-pilot latitude", "全国推开": "a nationwide rollout", "全面推开": "a full rollout", "重点地区": "designated key regions",
    "重点行业": "designated key industries", "分批": "a phased (batch) rollout", "试点": "pilot",
}
SCOPE_STOPS = ("支持", "开展", "推进", "推动", "实施", "围绕", "启动", "扩大", "深化")
BANS = {
    "一律不得": "flatly bars", "严禁": "expressly prohibits", "禁止": "prohibits", "严肃查处": "promises enforcement action against", "坚决防止": "commits to preventing",
    "不得": "bars",
}
RED_LINE = r"(守住|坚决守住)?(不发生)?([\x{4e00}-\x{9fff}]{0,10})(底线|红线)"
SUBJECTS = (
    "新能源汽车", "动力电池", "充电桩", "集成电路", "半导体", "芯片", "人工智能", "大模型", "算力", "算力枢纽", "专精特新", "中小企业", "制造业", "房地产", "地方债", "隐性债务",
    "保交楼", "关键矿产", "稀土", "菜籽油", "菜籽", "软木", "粮食安全", "乡村振兴", "耕地", "粤港澳", "长三角", "京津冀", "东北", "新疆", "西藏", "南海", "台海", "两岸", "台湾",
    "中加", "加拿大", "一带一路", "军工", "国防", "社会治理", "基层治理", "共同富裕", "舆情", "统一大市场", "双循环", "数据",
)


@dataclass(frozen=True)
class FactPack:
    """Everything that fact extraction depends on."""

    glossary: dict[str, str]
    actions: dict[str, str]
    bodies: dict[str, str]
    meetings: dict[str, str]
    roles: dict[str, str]
    unnamed: dict[str, str]
    instruments: dict[str, str]
    plural: tuple[str, ...]
    modifier_stops: tuple[str, ...]
    units: dict[str, int]
    vehicles: dict[str, str]
    qualifiers: dict[str, tuple[str, str]]
    quantity_qualifiers: tuple[str, ...]
    quantities: dict[str, tuple[int, str]]
    deadline: str
    relative: dict[str, str]
    scopes: dict[str, str]
    pilot: str
    scope_stops: tuple[str, ...]
    bans: dict[str, str]
    red_line: str
    subjects: tuple[str, ...]
    issued: str = "(近日|日前|已)?\\s*(印发|发布|公布|颁布)"
    letter: str = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"


MANDARIN_FACTS = FactPack(
    GLOSSARY, ACTIONS, BODIES, MEETINGS, ROLES, UNNAMED, INSTRUMENTS, PLURAL, MODIFIER_STOPS, MONEY_UNITS, VEHICLES, QUALIFIERS, QUANTITY_QUALIFIERS, QUANTITIES,
    DEADLINE, RELATIVE_TIMES, SCOPES, "试点", SCOPE_STOPS, BANS, RED_LINE, SUBJECTS,
)
