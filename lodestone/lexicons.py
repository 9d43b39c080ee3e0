"""Word lists, patterns and thresholds of the procurement domain.  All of these are fixed values."""

from __future__ import annotations

# Header names of the nine item fields, in order of precedence.
FIELD_ALIASES = {
    "product_service_name": ("货物名称", "标的名称", "产品名称", "设备名称", "服务名称", "采购标的", "标的物名称", "品名", "分项名称", "清单名称", "报价项目", "服务内容", "工程名称", "项目内容", "名称"),
    "category_name": ("品目名称", "品目分类", "采购品目", "品目"),
    "category_code": ("品目编码", "品目代码", "采购品目编码", "品目号"),
    "brand_supplier": ("货物品牌", "产品品牌", "品牌", "制造商", "生产厂家", "厂家"),
    "spec_model": ("规格型号", "货物型号", "产品型号", "技术规格", "型号", "规格", "配置"),
    "unit_price": ("成交单价", "投标单价", "含税单价", "货物单价", "产品单价", "单价"),
    "quantity": ("采购数量", "成交数量", "货物数量", "工程数量", "数量"),
    "quantity_unit": ("计量单位", "货物单位", "单位"),
    "total_price": ("成交金额", "中标金额", "投标总价", "货物合价", "合计金额", "小计金额", "总价", "合价", "合计", "小计", "金额"),
}
ENTITY_FIELDS = tuple(FIELD_ALIASES)
NUMERIC_FIELDS = ("unit_price", "quantity", "total_price")
SIGNAL_FIELDS = ("brand_supplier", "spec_model", "unit_price", "quantity", "total_price")
SERVICE_ALIASES = {
    "service_scope": ("服务范围", "施工范围"),
    "service_requirements": ("服务要求",),
    "service_time": ("服务时间", "施工工期", "服务期限"),
    "service_standard": ("服务标准",),
    "project_manager": ("项目经理",),
    "certificate": ("执业证书信息", "执业证书"),
}
# Selector scoring.
STRONG_PHRASES = ("主要标的信息", "主要成交标的", "中标标的", "成交标的", "分项报价", "报价明细", "开标一览", "中标产品", "成交产品", "货物清单", "产品清单")
OUTCOME_TERMS = ("中标", "成交", "结果公告", "结果公示", "中选", "报价")
FIELD_TERMS = ("货物名称", "标的名称", "产品名称", "服务名称", "品目", "品牌", "制造商", "规格型号", "型号", "单价", "数量", "总价", "合价", "金额")
SOURCE_BONUS = {"分项报价": 12, "报价明细": 12, "主要标的": 12, "开标一览": 10, "中标": 6, "成交": 6, "结果": 5, "报价": 5, "明细": 5, "清单": 4, "公示": 3}
NEGATIVE_SOURCE = ("中小企业声明", "授权委托", "资格声明", "廉洁承诺", "评分办法", "合同模板")
TEMPLATE_SOURCE = ("招标文件", "采购文件", "磋商文件", "谈判文件", "询价文件")
TEMPLATE_RELIEF = ("报价", "明细", "分项", "清单", "成交", "中标", "结果")
TEMPLATE_ROWS = ("佰拾万仟", "投标报价(大写)", "投标报价(小写)")
BOILERPLATE = ("打印", "关闭窗口", "版权所有", "网站标识码", "ICP备案")
BLANK_SIGNALS = ("/", "-", "—", "详见采购文件", "详见附件")
SUPPLIER_TABLE = ("供应商名称", "中标供应商", "成交供应商", "投标人名称")
MONEY = r"(?:人民币|￥|¥)?\s*\d[\d,]*(?:\.\d+)?\s*(?:万元|元)"
QUANTITY = r"\d+(?:\.\d+)?\s*(?:台|套|个|件|批|项|人|辆|册|只|支|组|月|年|次)"
TABLE_MIN, TEXT_MIN, CONTEXT, MAX_ROWS, MAX_CHARS = 22, 12, 2, 40, 9000
MAX_TEXT_GROUPS, MAX_SOURCES, FALLBACK_BLOCKS, FALLBACK_MIN = 4, 8, 5, 4
# Cleaning of cells.
PLACEHOLDERS = ("", "/", "-", "—", "无", "不涉及", "null", "none", "见附件", "详见附件", "见附件清单", "详见清单", "详见报价明细", "详见采购文件", "详见招标文件", "参数较多详见分项报价明细表", "以附件为准")
SUMMARY_TERMS = ("合计", "总计", "小计", "总价", "投标报价", "报价合计", "总报价", "备注", "废标", "流标")
QUANTITY_UNITS = ("平方米", "立方米", "人月", "人天", "公里", "千米", "万元", "小时", "台", "套", "个", "件", "批", "项", "人", "辆", "册", "只", "支", "组", "月", "年", "次", "吨", "米", "份", "包", "箱", "门", "宗")
# Source policy of the extraction.
RESULT_SOURCES = ("分项报价", "报价明细", "报价要求响应", "投标报价", "开标一览", "主要标的", "中标清单", "成交清单", "中标结果", "成交结果", "采购结果", "评审情况", "响应文件", "投标文件")
EXCLUDED_SOURCES = ("招标文件", "采购文件", "磋商文件", "谈判文件", "询价文件", "采购需求", "需求书", "技术需求", "评分办法", "资格预审文件")
LOW_VALUE_SOURCES = ("中小企业声明", "本国产品说明", "授权委托", "资格声明", "承诺函")
DRAFT_SOURCES = ("公开招标--", "公开招标-", "竞争性磋商--", "竞争性谈判--", "最终稿", "定稿")
SUMMARY_PREFIXES = ("合计", "总计", "小计", "总价", "投标报价", "报价合计", "总报价")
POLICY_TEMPLATE_ROWS = ("佰拾万仟", "佰拾万", "大写)￥(小写", "大写￥小写", "投标人名称(盖章)", "法定代表人(负责人)")
REQUIREMENT_TEXT = ("投标文件中须提供", "投标人须提供", "投标时须提供", "供应商须提供", "采购人有权要求", "否则按无效投标", "否则作无效投标")
TEMPLATE_TEXT = ("投标日期:xxxx", "由供应商填写", "严格按照招标文件要求", "此表不作为评审内容")
PLACEHOLDER_CELLS = ("详见附件", "见附件", "详见公告附件", "详见分项报价", "由供应商填写")
BUDGET_HEADERS = ("最高限价", "预算金额", "采购预算")
# Relation candidates and their evidence.
HEADER_ALIASES = {
    "org": ("供应商名称", "投标人名称", "投标单位名称", "投标供应商", "投标单位", "供应商", "投标人", "单位名称"),
    "amount": ("投标报价", "报价金额", "最终报价", "成交金额", "中标金额", "报价"),
    "score": ("评审得分", "综合得分", "得分"),
    "rank": ("排名", "排序", "名次"),
    "qualification": ("资格审查", "资格性审查"),
    "compliance": ("符合性审查", "响应性审查"),
    "result": ("中标情况", "成交情况", "评审结果", "结果", "备注"),
    "package": ("包号", "标包", "标段"),
}
RELATION_EXCLUDED = ("招标文件", "采购文件", "磋商文件", "谈判文件", "询价文件", "采购需求", "需求书", "评分办法", "资格预审文件")
ORG_SUFFIXES = ("公司", "集团", "中心", "医院", "大学", "学院", "学校", "研究院", "研究所", "事务所", "合作社", "委员会", "管理局", "政府", "分局", "总队", "支队", "大队", "厂", "站", "馆", "所", "院", "联合体")
ORG_PROSE = ("根据", "本项目", "供应商应", "投标人应", "采购人", "采购包", "评分", "得分标准", "技术要求", "商务要求", "应当", "须提供", "需提供", "符合以下", "详见", "文件中", "不接受联合体", "保证金", "有效期", "最高限价", "现场考察", "答疑会", "评标方法")
NOT_ORGS = ("是", "否", "通过", "不通过", "合格", "不合格")
RELATION_KEYWORDS = ("采购人", "采购单位", "代理机构", "项目编号", "采购编号", "招标编号", "采购方式", "供应商", "投标人", "中标", "成交", "候选", "报价", "得分", "排名", "资格审查", "符合性审查", "响应性审查", "包号", "标段")
RELATION_LOW_VALUE = ("中小企业声明", "本国产品", "授权委托", "资格声明", "承诺函")
RELATION_RESULT_SOURCES = ("评审情况", "采购结果", "中标", "成交", "结果公告", "结果公示")
RELATION_STRONG = ("供应商名称", "投标人名称", "中标供应商", "成交供应商", "中标（成交）金额", "评审总得分", "评审结果", "第一中标候选人", "第一成交候选人")
RELATION_BLANK = ("xxxxxx供应商", "由供应商填写", "投标人名称：____________", "投标人名称:____________")
RELATION_CHARS, RELATION_BLOCKS, LARGE_TABLE = 24_000, 40, 80
# Results, roles and organization types with their priority.
WON = ("中标", "成交")
UNIT_ROLE, AGENCY_ROLE = "采购单位", "代理机构"
ORG_PRIORITY = {"未知": 0, "投标参与方": 1, "产品供应商": 2, "代理机构": 2, "采购单位": 3, "中标供应商": 4}
ALIAS_LEAST = 0.88
DEFAULT_PACKAGE = "默认包"
# Admission of crawled notices.
RESULT_URL, EXCLUDED_TITLES = "/cggg/", "废标|流标|终止|更正|澄清|延期"
# Labels of jobs.
JOB_KINDS = {"task1": "任务一", "task2": "任务二"}
JOB_STATES = {"queued": "排队中", "running": "处理中", "completed": "已完成", "failed": "失败", "staged": "已接收"}
JOB_STAGES = {"upload": "接收文件", "validate": "校验文件", "parse": "解析 Blocks", "select": "筛选证据", "slotpack": "打包槽位", "extract": "模型抽取", "persist": "写入库", "ingest": "导入结果", "done": "完成", "error": "异常", "retry": "重试"}
