"""Word lists, weights and limits that results depend on."""

# Alias groups of queries; each key and its aliases expand one another.
QUERY_ALIASES = {
    "校历": ["教学日历", "教学周历", "2025-2026学年校历"],
    "慕课考试": ["慕课", "MOOC", "SPOC", "在线开放课程", "线下考试"],
    "期末考试": ["期末", "考试安排", "考场安排", "考试周"],
    "四六级": ["四级", "六级", "大学英语四级", "大学英语六级", "CET-4", "CET-6"],
    "转专业": ["专业变更", "转入转出", "转专业管理办法"],
    "规章制度": ["规章", "制度", "管理办法", "政策文件"],
    "办事流程": ["流程", "办理指南", "办事指南", "申请流程"],
    "学生相关文件及表格": ["学生表格", "常用下载", "表格下载", "学生相关文件"],
    "教务管理系统": ["正方教务", "教务系统", "jwxt"],
    "信息门户": ["综合信息服务", "智慧校园", "统一身份认证", "教务管理系统", "考试信息查询", "正方教务", "jwxt"],
    "大创": ["大学生创新创业", "创新创业", "创新训练", "创业训练"],
    "推免": ["免试攻读研究生", "推荐免试", "推免生"],
    "成绩": ["成绩查询", "成绩单", "绩点", "成绩复核"],
    "附件1": ["附件 1", "附件一", "附件"],
    "xlsx": ["xls", "Excel", "表格"],
    "学工": ["学生工作", "学生工作部", "学工要闻"],
    "奖学金": ["助学金", "资助", "评奖评优"],
    "困难认定": ["家庭经济困难学生认定", "家庭经济困难", "困难学生认定", "资助认定"],
    "助学金": ["资助", "奖助学金", "家庭经济困难"],
    "辅导员": ["辅导员队伍建设", "辅导员宣讲团"],
    "心理健康": ["心理咨询", "心理中心"],
    "双创": ["双创信息管理系统", "双创基地"],
    "互联网+": [],
    "竞赛报名": ["创新创业竞赛报名", "学科竞赛报名", "大赛报名"],
}

# Codes and impacts of indexed fields.
FIELD_IMPACTS = {"t": 120, "s": 60, "n": 55, "a": 95, "e": 95, "y": 95, "g": 45, "m": 16, "c": 10}
BLOCK_SIZE = 32

# Facets by keyword, first match wins.
FACET_WORDS = [
    ("exam", ["考试", "补考", "重修", "四六级", "慕课", "mooc", "考场"]),
    ("policy", ["规章", "制度", "管理办法", "policy", "regulation"]),
    ("workflow", ["办事流程", "办理", "流程", "申请", "指南"]),
    ("download", ["下载", "表格", "附件", "resource", "download", "forms"]),
    ("news", ["新闻", "快讯", "动态", "news"]),
]
FACETS = ["notice_article", "policy", "workflow", "download", "news", "exam", "system", "external"]
RECORD_TYPES = ["detail", "attachment", "external", "utility"]
EVIDENCE_LEVELS = ["metadata_only", "text_extracted", "ocr_extracted", "unavailable", "unknown"]

# Task kinds by keyword, after the rules on facet and record type.
TASK_FORM = ["申请表", "表格", "下载", "附件", "xls", "xlsx", "doc", "pdf"]
TASK_WORDS = [
    ("exam_schedule", ["期末考试", "考试安排", "补考", "重修考试", "考场", "慕课", "mooc"]),
    ("academic_calendar", ["校历", "教学周历", "教学日历", "放假安排"]),
    ("academic_policy", ["转专业", "推免", "免试攻读", "培养方案", "学籍", "管理办法"]),
    ("course_grade_credit", ["选课", "成绩", "学分", "课程"]),
]
TASK_AID = ["奖学金", "助学金", "资助", "家庭经济困难", "困难学生认定", "评奖评优"]
TASK_INNOVATION = ["双创", "创新创业", "大创", "互联网+", "挑战杯", "竞赛"]
AUTHORITY_PROFILES = {"jwc": "jwc_academic", "xsc": "xsc_student_affairs", "cxcy": "cxcy_innovation"}

# Intents in order, with their keywords, authoritative sources and freshness modes.
INTENTS = [
    ("system_entry", ["教务管理系统", "正方教务", "jwxt", "双创信息管理系统", "心理健康", "心理咨询", "信息门户", "系统", "门户"], None, "official_entry"),
    ("exam_schedule", ["期末考试", "考试安排", "补考", "缓考", "重修考试", "慕课考试", "考场", "考试周", "四六级", "口语考试", "计算机等级", "普通话", "普通话考试"], ["jwc"], "current_term"),
    ("academic_calendar", ["校历", "教学周历", "教学日历", "放假安排", "开学时间", "寒假", "暑假"], ["jwc"], "current_term"),
    ("form_download", ["申请表", "表格", "xlsx", "xls", "下载", "附件"], ["jwc", "xsc", "cxcy"], "form_version"),
    ("academic_policy", ["转专业", "推免", "推荐免试", "免试攻读", "培养方案", "学籍", "管理办法", "规章制度", "政策文件"], ["jwc"], "current_policy"),
    ("course_grade_credit", ["选课", "成绩", "绩点", "学分", "课程", "教材"], ["jwc"], "current_notice"),
    ("scholarship_aid", ["奖学金", "助学金", "资助", "困难认定", "家庭经济困难", "评奖评优", "勤工助学", "助学贷款"], ["xsc"], "current_notice"),
    ("student_affairs", ["辅导员", "心理", "宿舍", "征兵", "就业", "学工", "一站式", "防诈骗", "消防"], ["xsc"], "balanced"),
    ("innovation_entrepreneurship", ["大创", "创新创业", "双创", "互联网+", "挑战杯", "竞赛报名", "竞赛", "创业", "学科竞赛"], ["cxcy"], "current_term"),
]
FALLBACK_INTENT = ("broad_exploratory", ["jwc", "xsc", "cxcy"], "balanced")
SYSTEM_AUTHORITY = [
    ("cxcy", ["双创", "创新创业", "大创", "竞赛", "挑战杯", "互联网+", "创业"]),
    ("xsc", ["心理", "学工", "资助", "就业", "征兵", "奖学金", "助学金", "困难认定", "辅导员", "宿舍"]),
]
SYSTEM_DEFAULT_AUTHORITY = ["jwc"]

# Ranking weights.
TEXT_MATCH = {"title_exact": 2400, "system_title_exact": 5200, "title_contains": 2400, "long_query": 4, "long_title_extra": 1400, "attachment": 520, "external": 440, "url": 220, "section": 260, "content": 120, "tags": 120}
TERM_MATCH = {"title": 92, "attachment": 78, "external": 68, "url": 55, "section": 48, "body": 12}
AUTHORITY = {"focused": 1900, "broad": 260, "single_miss": 1200}
FACET_BOOSTS = [
    ("system", ["system_entry"], 2100, "系统入口"),
    ("download", ["form_download"], 1150, "下载资源"),
    ("policy", ["academic_policy", "scholarship_aid"], 1050, "政策制度"),
    ("workflow", ["form_download", "course_grade_credit"], 520, "办事流程"),
    ("exam", ["exam_schedule"], 1250, "考试相关"),
]
TASK_KIND_MATCH = 900
FRESHNESS = {"form_version": (2800, 3650, "版本较新"), "current_policy": (5200, 1825, "时间较新"), "current_term": (7200, 1460, "时间较新"), "current_notice": (5600, 1825, "时间较新"), "balanced": (900, 3650, "时间较新")}
OFFICIAL_ENTRY = (220, "官方入口")
STALE_MODES = ["current_notice", "current_term", "current_policy"]
STALE = [(3650, 6600, None), (2190, 4800, None), (1460, 3000, None), (365, 2600, ["current_term"]), (180, 650, ["current_term"])]
SHORT_LANDING, FORM_EXTERNAL, HARDSHIP = 2600, 2200, 1800
UNSEEN_LIGHT_SCORE = 24
FALLBACK_BOOST, FALLBACK_BELOW = 90, 8

# Snippet weights and sizes.
SNIPPET_WEIGHTS = {"content": 90, "summary": 82, "attachments": 76, "title": 70, "nav_path": 58, "url": 30}
SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_FALLBACK = 24, 112, 180

# Limits of the planner and of Bloom filters.
BLOOM_BITS, BLOOM_HASHES, FNV_BASIS, FNV_PRIME = 16384, 3, 2166136261, 16777619
CANDIDATES, QUICK_CANDIDATES, BODY_CANDIDATES = 160, 48, 96
QUICK_SHARDS, BODY_SHARDS, BATCH = 8, 18, 4
PHASE_BUDGETS = ((5 << 20, 6), (10 << 20, 12))
MAX_LOCAL_REFS = 48
REF_UTILITY = {"routed": 4.0, "source": 2.0, "facet": 1.5, "first_year": 2015, "years": 10, "oldest": 0.2, "newest": 1.2}

# Headers of exam tables, the first that exists wins.
EXAM_HEADERS = {
    "campus": ["校区", "校区名称"],
    "course_name": ["课程名称", "课程", "考试课程"],
    "course_code": ["课程代码", "选课课号"],
    "class_name": ["班级名称", "班级", "班级代码", "行政班级"],
    "teacher": ["任课教师", "教师", "监考教师"],
    "location": ["考试教室", "教室名称", "地点", "考试地点"],
    "raw_time": ["考试时间", "时间"],
    "count": ["人数", "学生人数", "考试人数"],
    "school": ["开课学院", "学院"],
    "student_school": ["学生所在学院", "所在学院"],
    "major": ["专业名称", "专业"],
    "grade": ["年级"],
    "notes": ["备注"],
}
CLASS_LOOKUP = r"^[BFPQY]\d{2,}(?:\([A-Z0-9]+\))?$"
COMPLETE_CLASS = r"^[BFPQY]\d{6}(?:\([A-Z0-9]+\))?$"
EXAM_HELPER = "考试安排"
QUICK_PRESETS = ["校历", "慕课考试", "学生相关文件及表格", "教务管理系统", "转专业", "奖学金", "大创", "附件1"]

# The counts that a package states of itself.
TRUTH_COUNTS = ["sections", "nav_nodes", "homepage_modules", "list_pages", "detail_pages", "low_content_detail_pages", "attachments", "external_links", "edges", "url_outcomes"]
