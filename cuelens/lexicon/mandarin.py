"""The Mandarin pack: cues of public policy texts.

The word lists, patterns and weights below are fixed values; results depend on each of them.
"""

from __future__ import annotations

from cuelens.lexicon.mandarin_facts import GLOSSARY
from cuelens.lexicon.rules import All, AtLeast, Desk, Has, No, NotAfter, Pack, Rule, Signal

# Stock phrases.
BOILERPLATE = (
    Rule("习近平新时代中国特色社会主义思想", "习近平新时代中国特色社会主义思想"),
    Rule("以习近平同志为核心", "以习近平同志为核心"),
    Rule("两个确立|两个维护", "两个确立|两个维护"),
    Rule("四个意识|四个自信", "四个意识|四个自信"),
    Rule("伟大复兴|中国梦", "中华民族伟大复兴|中国梦"),
    Rule("高质量发展", "高质量发展"),
    Rule("新发展理念", "新发展理念"),
    Rule("统筹发展和安全", "统筹发展和安全"),
    Rule("坚持…推动…抓好", "坚持(?!党的领导.{0,6}制度)[^。]{0,8}(推动|抓好|持续)"),
    Rule("深入贯彻落实", "深入贯彻落实|全面贯彻落实|认真贯彻落实"),
    Rule("提高政治站位", "提高政治站位|增强四个意识"),
    Rule("凝心聚力|砥砺前行", "凝心聚力|砥砺前行|奋勇前进|再创辉煌"),
    Rule("人民至上|以人民为中心", "人民至上|以人民为中心"),
    Rule("强调指出要求", "会议强调|会议指出|强调要|指出要|要求各"),
    Rule("社会和谐稳定", "社会和谐稳定|安定团结"),
    Rule("正能量", "正能量|主旋律"),
)

# Kinds of checkable detail.
DETECTORS = (
    Rule("numeric_target", r"\d+(\.\d+)?\s*(%|％|个百分点|亿|万亿|万人|万吨|亿元|万亿元|倍)"),
    Rule("timeline", r"(到|于|自)?\d{4}\s*年(底|前|以来)?|(「|“)?十四五(」|”)?|(「|“)?十五五(」|”)?|本月底|年内|季度|月内|限期"),
    Rule("named_instrument", "实施细则|实施方案|管理办法|配套办法|办法|条例|通知|意见|目录|清单|白皮书|行动计划|试点方案"),
    Rule("responsible_body", "国务院办公厅|国家发改委|工业和信息化部|商务部|外交部|财政部|中国人民银行|农业农村部|各省级人民政府|有关部门要"),
    Rule("pilot_or_scope", "试点|先行先试|全国推开|分批|局部|在.+范围|重点地区|重点行业"),
    Rule("constraint_or_ban", "不得|严禁|禁止|红线|底线|坚决守住|一律不得|严肃查处|问责"),
    Rule("resource_or_funding", "专项资金|财政支持|贴息|补贴|拨款|额度|债券|专项债|预算安排"),
    Rule("named_sector_or_place", "芯片|半导体|人工智能|房地产|地方债|菜籽|稀土|粤港澳|长三角|京津冀|东北|新疆|西藏|台湾|南海|[一-龥]{2,6}(省|自治区|自治州|市|地区|县|区)"),
    Rule("delta_or_priority_shift", "首次|更加突出|把.+放在|优先|重中之重|从.+转向|不再|淡化|暂缓|加力|加码"),
    Rule(
        "official_action",
        "任命|免去.{0,6}职务|正式免职|调任|当选|连任|辞去.{0,6}职务|挂职|接受.{0,4}审查调查|立案审查|立案侦查|双开|开除党籍|开除公职|撤销.{0,6}职务|留党察看|党内警告|批准逮捕|提起公诉|一审判决|获刑"
        "|会见|会晤|正式访问|签署.{0,10}(协议|备忘录|合作)|成功发射|发射成功|发射升空|圆满成功|首飞|下水|交付使用|正式投产|正式开业|正式启用|揭牌|正式开工|竣工|启动仪式|论坛.{0,4}举办"
        "|颁奖仪式|颁授.{0,6}(奖章|证书|勋章)|授称|荣获|获得.{0,6}(冠军|奖|奖项)|夺得|摘得",
    ),
    Rule("named_campaign", "网络安全周|安全生产月|宪法宣传周|国家安全教育日|普法宣传周|主题教育活动|专项行动|巡回宣讲|进校园活动|进社区活动|进企业活动|进农村活动|培训班|学习班|观摩活动|文明实践.{0,6}活动|宣传月|宣传周"),
)

# What makes a hard cue actionable, by kind.
ACTIONABLE = {
    "named_instrument": "印发|通知|条例|决定|公告|意见|方案|配套办法|实施细则|管理办法已|已出台",
    "resource_or_funding": r"\d",
    "numeric_target": "亿|万亿|％|%|专项|试点|配套|产能|装机|备案",
    "timeline": "出台|印发|实施|落地|安排|专项|试点|配套|办法|通知",
    "official_action": "",
    "named_campaign": "",
}

_INSTRUMENT = Has("实施细则|实施方案|办法|条例|通知|意见")
_PARTY, _STATE = "党中央|中共中央|党的", "国务院|各部委|有关部门"
_SLOGAN = Has("强调|坚持|推动|抓好|持续")
_STABLE, _GROW = Has("稳定|安全|风险|忧患"), Has("发展|增长|回升|改革")

# Signaling rules, weights in hundredths.
SIGNALS = (
    Signal("seq-party-before-state", "sequence", 8, (("hit", NotAfter(_PARTY, _STATE)), ("miss", All((Has(_PARTY), Has(_STATE)))), ("hit", Has(_PARTY)))),
    Signal("seq-meeting-to-document", "sequence", 7, (("hit", All((Has("会议|公报|纪要"), Has("印发|出台|发布|通知|意见")))), ("miss", Has("会议|公报|纪要")))),
    Signal("seq-leader-title-order", "sequence", 4, (("hit", AtLeast("总书记|国家主席|总理|人大常委会委员长|政协主席|中央纪委书记|书记处书记|主任|部长", 2)),)),
    Signal("detail-named-instrument", "implementing_detail", 12, (("hit", _INSTRUMENT), ("miss", No(_INSTRUMENT)))),
    Signal("detail-promised-later", "implementing_detail", 5, (("hit", Has("另行制定|具体办法|细则另行|另行公布")),)),
    Signal("detail-slogan-only", "implementing_detail", 6, (("hit", All((_SLOGAN, No(_INSTRUMENT)))), ("miss", _INSTRUMENT))),
    Signal("press-xinhua-wire", "press_placement", 7, (("hit", Has("新华社")),)),
    Signal("press-peoples-daily", "press_placement", 6, (("hit", Has("人民日报")),)),
    Signal("press-front-page", "press_placement", 8, (("hit", Has("头版|要闻")),)),
    Signal("press-editorial-genre", "press_placement", 7, (("hit", Has("社论|评论员文章|仲音")),)),
    Signal("press-authoritative-byline", "press_placement", 9, (("hit", Has("任仲平|钟声|国纪平|金观平|秋石")),)),
    Signal("verb-hierarchy-cues", "speech_verbs", 5, (("hit", Has("指出|强调|要求|重申|部署")),)),
    Signal("attr-collective-center", "attribution", 4, (("hit", Has("党中央|中央经济工作会议|会议指出|会议强调")), ("miss", Has("我[在讲]|个人认为")))),
    Signal("attr-ministry-issuer", "attribution", 4, (("hit", Has("部昨日|部印发|总局|央行|发改委|工信部|财政部|商务部")),)),
    Signal("attr-personal-leadership", "attribution", 5, (("hit", Has("亲自谋划|亲自部署|亲自推动|亲自主持|亲自出席|亲自指挥|亲自决策")),)),
    Signal("conc-numeric-targets", "concreteness", 6, (("hit", Has(r"\d+(\.\d+)?%|\d+亿|\d+万|不低于|左右")), ("miss", No(Has(r"\d+(\.\d+)?%|\d+亿|\d+万|不低于|左右"))))),
    Signal("conc-timeline", "concreteness", 4, (("hit", Has(r"\d{4}年|年底前|年内|“十四五”|“十五五”|到\d{4}")),)),
    Signal("scope-pilot-vs-national", "rollout_scope", 4, (("hit", Has("试点|先行先试|示范区")), ("hit", Has("全国范围|全面推开|各地要")))),
    Signal("tone-stability-prosperity", "tone_framing", 3, (("hit", All((_STABLE, _GROW))), ("miss", All((No(_STABLE), No(_GROW)))))),
    Signal("tone-minimize-language", "tone_framing", 4, (("hit", Has("个别|极少数|不代表整体|局部现象")),)),
    Signal("tone-resolve-language", "tone_framing", 4, (("hit", Has("坚决维护|严厉打击|高度重视|坚决防止|绝不允许")),)),
    Signal("diplo-severity-ladder", "diplomatic_severity", 5, (("hit", Has("严重抗议|强烈谴责|严重关切|极大的愤慨|表示遗憾|谴责|抗议|关切")),)),
    Signal("diplo-outcome-euphemism", "diplomatic_severity", 4, (("hit", Has("建设性对话|亲切友好|坦率交谈|增进了了解|态度是积极的|交换了意见")),)),
)

# Kinds of information, weights in thousandths.
KINDS = (
    Rule("leadership_meeting", "中央经济工作会议|中央政治局|中央全会|两会|全国人大|全国政协|总书记", 1000),
    Rule("macro_policy", "高质量发展|稳增长|宏观调控|积极的财政政策|稳健的货币政策|扩大内需|新质生产力", 950),
    Rule("implementing_instrument", "实施细则|实施方案|办法|条例|通知|意见|印发", 900),
    Rule("industrial_tech_policy", "新质生产力|芯片|半导体|人工智能|专精特新|制造业|关键核心技术|卡脖子", 850),
    Rule("foreign_affairs", "一带一路|人类命运共同体|外交部|外事|制裁|南海|台湾", 850),
    Rule("defense_public", "国防|军队|解放军|军委|军工|强军|演训|战备|国防白皮书|军民融合", 840),
    Rule("finance_risk", "金融风险|地方债|隐性债务|保交楼|房地产|系统性风险|资本无序扩张|去杠杆", 820),
    Rule("dual_circulation", "双循环|国内大循环|国际循环|统一大市场|供应链|产业链|安全可控|国产替代", 800),
    Rule("five_year_plan", "五年规划|十四五|十五五|规划纲要|远景目标|二〇三五|2035", 780),
    Rule("rural_revitalization", "乡村振兴|三农|耕地|粮食安全|种业|脱贫攻坚|防止返贫|高标准农田|农业农村", 760),
    Rule("ideology_party", "意识形态|思想政治工作|主题教育|学习贯彻|二十大|党的建设|全面从严治党|反腐败|巡视", 740),
    Rule("social_governance", "社会和谐稳定|社会治理|正能量|舆情|民生|共同富裕", 720),
    Rule("economic_data", r"GDP|同比增长|百分点|居民消费|通胀|失业率|\d+(\.\d+)?%", 700),
    Rule("press_commentary", "社论|评论员文章|仲音|任仲平", 650),
    Rule("local_policy", "省政府|市委|市政府|自治区|因地制宜|各地各部门", 550),
)

_NATIONAL = ("leadership_meeting", "macro_policy", "implementing_instrument", "foreign_affairs", "defense_public", "finance_risk")
# What moves importance, in thousandths; a tuple of kinds, or a condition on the text and kinds that must be absent.
DRIVERS = (
    ("leadership_meeting", 280, ("leadership_meeting",)),
    ("macro_policy", 120, ("macro_policy",)),
    ("implementing_instrument", 140, ("implementing_instrument",)),
    ("high_salience_domain", 60, ("foreign_affairs", "finance_risk", "industrial_tech_policy", "defense_public")),
    ("diaspora_or_bri_priority", 80, (Has("华人|华侨|海外同胞|侨务|一带一路|人类命运共同体"), ())),
    ("trade_investment_priority", 80, (Has("外贸|进出口|外商投资|外资准入|贸易顺差|贸易逆差|关税|出口管制|双边投资协定|FDI"), ())),
    ("taiwan_strait_priority", 80, (Has("台海|两岸|台湾问题|一个中国|反独促统|武统|环台|解放军.{0,6}台|台.{0,6}军演"), ())),
    ("subnational_personnel_low_priority", -100, (Has("任命|免去.{0,6}职务|调任|挂职|接受.{0,4}审查调查|立案审查|立案侦查|双开|开除党籍|开除公职|留党察看|党内警告"), _NATIONAL)),
    ("job_fit_domain_coverage", 120, ("rural_revitalization", "ideology_party", "dual_circulation", "five_year_plan", "social_governance")),
    ("authoritative_or_front_press_cue", 100, (Has("新华社|人民日报|头版|要闻"), ())),
)

# Hot themes.
THEMES = (
    Rule("taiwan_strait", "台海|两岸|海峡两岸|台湾问题|一个中国|反独促统|金门|马祖|武统|赖清德|民进党|解放军.*台|台.*军演|环台"),
    Rule("electric_vehicles", "电动汽车|新能源汽车|新能源车|电动车|动力电池|锂电池|充电桩|比亚迪|特斯拉中国|整车出口.*电|汽车出口"),
    Rule("china_ai", r"人工智能|大模型|生成式\s*AI|生成式人工智能|ChatGPT|DeepSeek|算力|智算|AI\s*芯片|机器学习|算法备案"),
    Rule("semiconductors", "芯片|半导体|集成电路|晶圆|光刻|先进制程|国产替代.*芯|存储芯片"),
    Rule("critical_minerals", "关键矿产|稀土|锂矿|镍矿|钴矿|石墨出口管制|出口管制.*稀土"),
)

# Desks in order.
DESKS = (
    Desk("hot_topics", "台海|两岸|台湾问题|电动汽车|新能源汽车|电动车|人工智能|大模型|DeepSeek|芯片|半导体|稀土|关键矿产|出口管制"),
    Desk(
        "economy_investment",
        "财政政策|货币政策|扩大内需|稳增长|投资|专项资金|专项债|专精特新|地方债|房地产|保交楼|化债|制造业|营商环境|中央经济工作会议|政府工作报告|十四五|十五五|高质量发展|新质生产力|双循环|统一大市场|积极的财政|稳健的货币",
        ("finance_risk", "economic_data", "implementing_instrument", "leadership_meeting", "macro_policy", "five_year_plan", "dual_circulation"),
    ),
    Desk("industrial_tech", "制造强国|科技自立自强|专精特新|产业政策|数字经济|战略性新兴产业|卡脖子|国产替代|工业和信息化部|工信部|产业链供应链", ("industrial_tech_policy",)),
    Desk("foreign_affairs", "外交部|外事|一带一路|人类命运共同体|中加|加方|加拿大|制裁|双边|多边|联合国|G7|CPTPP", ("foreign_affairs",)),
    Desk("defense_public", "国防|军队|解放军|军委|军工|武警|演训|战备|国防白皮书|强军|军民融合|海空|航母", ("defense_public",)),
    Desk(
        "social_governance",
        "社会治理|基层治理|民生|共同富裕|舆情|正能量|和谐稳定|主题教育|意识形态|巡视|乡村振兴|粮食安全|三农|教育部|双减|教育改革|职业教育",
        ("social_governance", "ideology_party", "rural_revitalization"),
    ),
)

# Where a text comes from.
SOCIAL = (
    Rule("李老师不是你老师", "李老师不是你老师|李老师"),
    Rule("twitter/x", r"(?i)twitter\.com|x\.com/|推特|Tweet"),
    Rule("微博", "(?i)微博|weibo"),
    Rule("网传/据说", "网传|据传|据说有视频|有视频显示|未证实"),
    Rule("自媒体", "自媒体|大V|博主称"),
)
CLASSES = (
    Rule("policy_instrument", "实施细则|实施方案|管理办法|印发通知|条例"),
    Rule("official_or_wire", "新华社|人民日报|外交部|国防部|国务院|工信部|商务部|例行记者会"),
    Rule("press_commentary", "社论|评论员文章|仲音|观察者网评论"),
)
THINK_TANK = "发展研究中心|国务院发展研究中心|中国社科院|社会科学院|商务部研究院|国际贸易经济合作研究院|智库|研究中心发布"
NEXUS_DIRECT = (
    Rule("加拿大", "加拿大"),
    Rule("加方", "加方"),
    Rule("加中|中加", "加中|中加"),
    Rule("渥太华", "渥太华"),
    Rule("多伦多", "多伦多"),
    Rule("温哥华", "温哥华"),
    Rule("Canada", r"(?i)\bCanada\b"),
    Rule("Canadian", r"(?i)\bCanadian\b"),
    Rule("Ottawa", r"(?i)\bOttawa\b"),
    Rule("CUSMA|USMCA", r"\bCUSMA\b|\bUSMCA\b|美墨加协定|美加墨"),
)
NEXUS_POSSIBLE = (
    Rule("北极/Arctic", "(?i)北极|Arctic"),
    Rule("关键矿产", r"(?i)关键矿产|稀土|锂矿|镍矿|critical\s+minerals"),
    Rule("菜籽/canola", "(?i)菜籽|油菜籽|canola"),
    Rule("软木/softwood", "(?i)软木|木材出口|softwood"),
    Rule("CPTPP", "CPTPP|全面与进步跨太平洋|跨太平洋伙伴"),
    Rule("G7", r"(?i)\bG7\b|七国集团"),
    Rule("北美", "北美(?!洲板块)"),
)

# Relative dates in order, with the days they are taken to mean.
RELATIVE_DATES = (("今日", 0), ("昨天", 1), ("昨日", 1), ("日前", 3), ("近日", 5), ("近期", 14), ("最近", 10), ("本周", 3), ("本月", 15))

# English of a nugget that makes it actionable, what one without English is called, and the kinds of fact that explain one.
ACTIONABLE_EN = {
    "named_instrument": r"(?i)\b(notice|circular|regulation|ordinance|issued)\b",
    "resource_or_funding": "(?i)RMB|billion|million|yuan|USD",
    "numeric_target": "(?i)RMB|billion|percent|pilot",
}
CUE_PHRASES = {
    "numeric_target": "a numeric figure (see quoted excerpt)",
    "timeline": "a time marker (see quoted excerpt)",
    "named_instrument": "a policy instrument (see quoted excerpt)",
    "responsible_body": "an issuing body (see quoted excerpt)",
    "pilot_or_scope": "a pilot or scope boundary (see quoted excerpt)",
    "constraint_or_ban": "a constraint or red line (see quoted excerpt)",
    "resource_or_funding": "a funding or resource line (see quoted excerpt)",
    "named_sector_or_place": "a named sector or place (see quoted excerpt)",
    "delta_or_priority_shift": "a priority or wording-shift cue (see quoted excerpt)",
    "official_action": "a named official action (see quoted excerpt)",
    "named_campaign": "a named campaign or activity (see quoted excerpt)",
}
FACT_KINDS = {
    "numeric_target": ("quantity", "money"),
    "timeline": ("deadline",),
    "named_instrument": ("instrument",),
    "responsible_body": ("actor",),
    "pilot_or_scope": ("scope",),
    "constraint_or_ban": ("prohibition",),
    "resource_or_funding": ("money",),
    "named_sector_or_place": ("subject",),
    "delta_or_priority_shift": (),
    "official_action": ("actor",),
    "named_campaign": (),
}

# Issuers, subjects and stock phrases that sources are compared by.
ISSUERS = (
    "新华社", "人民日报", "光明日报", "经济日报", "求是", "中新社", "央视", "中国政府网", "国务院办公厅", "国务院国资委", "国务院台办", "国台办", "国务院", "国家发展改革委", "国家发改委",
    "工业和信息化部", "商务部", "外交部", "财政部", "教育部", "科技部", "农业农村部", "交通运输部", "自然资源部", "生态环境部", "国防部", "国家统计局", "中国人民银行",
    "国家金融监督管理总局", "中国证监会", "海关总署", "市场监管总局", "国家能源局", "国家网信办", "省级人民政府",
)
SUBJECTS = (
    "中央经济工作会议", "中央政治局会议", "中央金融工作会议", "中央财经委员会", "中央全会", "全国两会", "十四五", "十五五", "新质生产力", "专精特新", "产业链供应链", "关键核心技术",
    "芯片", "半导体", "人工智能", "新能源汽车", "房地产", "保交楼", "地方债", "隐性债务", "系统性金融风险", "资本无序扩张", "稀土", "菜籽", "软木", "粮食安全", "乡村振兴", "共同富裕",
    "全国统一大市场", "双循环", "一带一路", "两岸", "台海", "台湾", "南海", "粤港澳", "长三角", "京津冀", "新疆", "西藏", "主题教育", "社会治理", "强军", "练兵备战",
)
FORMULA = (
    "习近平新时代中国特色社会主义思想", "以习近平同志为核心", "中国特色社会主义", "中华民族伟大复兴", "高质量发展", "深入贯彻落实", "全面贯彻落实", "认真贯彻落实", "新发展理念",
    "统筹发展和安全", "提高政治站位", "增强四个意识", "四个自信", "两个维护", "两个确立", "凝心聚力", "砥砺前行", "人民至上", "以人民为中心", "保障和改善民生", "社会和谐稳定",
    "安定团结", "正能量", "主旋律", "经济社会发展", "持续健康发展", "健康稳定发展", "改革开放", "有关部门", "有关负责人", "有关方面", "相互尊重", "扎实推进", "会议强调", "会议指出",
    "会议要求",
)
# Cues of a record's role on its desk.
ROLE_CUES = {"defense_public": "国防|解放军|强军", "diplomatic": "外交部|一带一路|中加|加方", "social_or_ideology": "社会治理|主题教育|乡村振兴"}
# A record that a reviewer can look up, wording that promises, numbers or times within a passage.
TRACEABLE = "《[^》]{2,40}》|据(新华社|人民日报|中新社|央视|经济日报|光明日报|中国政府网)|新华社[^，。]{0,6}电|援引|转引自"
CALORIES = {"posture": Has("强调|坚持|推动|抓好"), "slogan": Has("高质量发展|新质生产力"), "propaganda": Has("正能量|主旋律|意识形态|主题教育")}
NUMERIC = r"\d+(\.\d+)?\s*(%|％|亿|万|亿元)|20\d{2}\s*年|年内|年底前"

MANDARIN = Pack(
    name="mandarin",
    boilerplate=BOILERPLATE,
    detectors=DETECTORS,
    actionable=ACTIONABLE,
    support=("responsible_body", "named_sector_or_place"),
    signals=SIGNALS,
    kinds=KINDS,
    drivers=DRIVERS,
    themes=THEMES,
    desks=DESKS,
    default_desk="economy_investment",
    social=SOCIAL,
    classes=CLASSES,
    nexus_direct=NEXUS_DIRECT,
    nexus_possible=NEXUS_POSSIBLE,
    actionable_en=ACTIONABLE_EN,
    fact_kinds=FACT_KINDS,
    glossary=GLOSSARY,
    cue_phrases=CUE_PHRASES,
    subjects=SUBJECTS,
    issuers=ISSUERS,
    formula=FORMULA,
    gray="CPTPP|北极|极地|关键矿产|北美|双边投资|菜籽|软木",
    instrument="实施细则|实施方案|管理办法|配套办法|印发通知|通知|意见|条例",
    meeting="中央经济工作会议|中央政治局|中央全会|两会|会议强调|会议指出",
    extra={"think_tank": THINK_TANK, "defense": ("defense_public", Has("国防|解放军|军委|强军|军工")), "instrument_over_meeting": Has("印发|实施细则|实施方案|配套办法"), "roles": ROLE_CUES, "traceable": Has(TRACEABLE), "calories": CALORIES, "numeric": Has(NUMERIC)},
)
