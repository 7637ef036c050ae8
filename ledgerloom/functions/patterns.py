"""The word lists and codes that decide results. Plain text, in the order in which they are tried."""

JUDICIAL = "司法划扣|司法扣划|法院划扣|法院扣划|司法扣款|冻结扣划|强制扣划|强制执行扣款|(?:网络)?执行查控.{0,12}(?:扣划|划扣)|网络查控.{0,20}(?:扣划|划扣)"
JUDICIAL_PARTY = "网络.*查控.*(?:扣划|划扣)|(?:扣划|划扣).*专户"
JUDICIAL_NAME = "【司法机关划扣】"
CASH_CONTEXT = "(?:^|[^A-Za-z0-9_])ATM(?:$|[^A-Za-z0-9_])|现金取款|取现|柜面取款"
CASH_NAME = "【现金取现】"
UNKNOWN_NAME = "【无对手方名称／用途待核对】"
UNKNOWN_PARTY = "^【(?:无对手方|.*用途待核对)"
RELATIVE_SUMMARY = "生活费|赡养|学费|零用钱|配偶|亲属|儿子|女儿|父母"
FEE_WAIVER = "减免|免收|豁免|优惠|抵扣"
SETTLEMENT = "结息|利息结算|计息"
NATIONAL_ID = r"^[1-6][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9xX]$"
PLACEHOLDER_ACCOUNT = "待核验|待归属|未知|未识别|unknown"

#: transaction type, direction, flow code
FLOW_TYPES = (
    ("司法扣划", "OUT", "JUDICIAL_DEDUCTION"),
    ("贷款放款", "IN", "LOAN_DISBURSEMENT"),
    ("贷款还款", "OUT", "LOAN_REPAYMENT"),
    ("信用卡还款", "OUT", "LOAN_REPAYMENT"),
    ("信用卡还款", "IN", "TRANSFER_IN"),
    ("工资收入", "IN", "SALARY_INCOME"),
    ("存款结息", "IN", "INTEREST_INCOME"),
    ("退款", "IN", "REFUND_REVERSAL"),
    ("分期退款", "IN", "REFUND_REVERSAL"),
    ("手续费", "OUT", "TAX_AND_FEES"),
    ("透支利息", "OUT", "TAX_AND_FEES"),
    ("保险支出", "OUT", "INSURANCE"),
    ("消费", "OUT", "CONSUMPTION"),
    ("缴费", "OUT", "CONSUMPTION"),
    ("账户转账", "IN", "TRANSFER_IN"),
    ("账户转账", "OUT", "TRANSFER_OUT"),
    ("第三方支付", "IN", "TRANSFER_IN"),
    ("第三方支付", "OUT", "TRANSFER_OUT"),
    ("分期", "OUT", "LOAN_REPAYMENT"),
)

#: direction, words, flow code; tried in this order on lower-case text
FLOW_WORDS = (
    ("IN", "放款|贷款入账|贷款发放|借款发放", "LOAN_DISBURSEMENT"),
    ("IN", "工资|薪资|薪酬|奖金|劳务|代发", "SALARY_INCOME"),
    ("IN", "退款|退货|冲正|撤销|退汇", "REFUND_REVERSAL"),
    ("IN", "结息|利息收入|存款利息", "INTEREST_INCOME"),
    ("OUT", "(?:^|[^A-Za-z0-9_])atm(?:$|[^A-Za-z0-9_])|现金取款|现金支取|取现|柜面取款", "CASH_WITHDRAWAL"),
    ("OUT", "贷款还款|偿还贷款|还贷|还本|按揭|房贷|车贷|信用卡还款|透支还款|分期付款到期扣收", "LOAN_REPAYMENT"),
    ("OUT", "理财|基金|证券|银证|股票|债券|贵金属|黄金|投资", "INVESTMENT_WEALTH"),
    ("OUT", "保险|保费|寿险|财险", "INSURANCE"),
    ("OUT", "手续费|服务费|年费|工本费|账户管理费|税款|税费|纳税|透支利息|罚息", "TAX_AND_FEES"),
    ("OUT", "消费|购物|餐饮|商户|pos|快捷支付|微信|支付宝|财付通|京东|美团|拼多多|水费|电费|燃气|话费", "CONSUMPTION"),
)
TRANSFER_IN_WORDS = "转账|汇款|入账|收款"
TRANSFER_OUT_WORDS = "转账|汇款|付款|支付"

#: flow code, label, direction, priority
FLOW_CODES = (
    ("LOAN_DISBURSEMENT", "贷款放款", "IN", 90),
    ("SALARY_INCOME", "工资及劳务收入", "IN", 80),
    ("REFUND_REVERSAL", "退款及冲正", "IN", 60),
    ("INTEREST_INCOME", "利息及结息", "IN", 40),
    ("TRANSFER_IN", "他人转入", "IN", 50),
    ("OTHER_IN", "其他／待核对流入", "IN", 100),
    ("JUDICIAL_DEDUCTION", "司法划扣", "OUT", 100),
    ("CASH_WITHDRAWAL", "现金取现", "OUT", 90),
    ("LOAN_REPAYMENT", "贷款及信用卡还款", "OUT", 80),
    ("INVESTMENT_WEALTH", "投资理财及证券", "OUT", 75),
    ("INSURANCE", "保险支出", "OUT", 70),
    ("TAX_AND_FEES", "税费及银行费用", "OUT", 65),
    ("CONSUMPTION", "消费及生活支出", "OUT", 50),
    ("TRANSFER_OUT", "对外转账", "OUT", 40),
    ("OTHER_OUT", "其他／待核对流出", "OUT", 100),
)

#: milestone column, tag once reached; later milestones win, of equal dates the earlier in this list
PHASES = (
    ("t1", "【诉讼保全期间】"),
    ("t2", "【判决生效后至立案前】"),
    ("t3", "【执行立案后】"),
    ("t4", "【报告财产令后】"),
    ("t5", "【查封冻结后】"),
    ("t6", "【和解协议后】"),
)
PHASE_BEFORE_DEBT = "【债务形成前】"
PHASE_BEFORE_SUIT = "【债务形成后至起诉前】"
PHASE_DEFAULT = "常规期间"

R02_SUMMARY = "取现|现金|ATM|柜面取款|支取现金"
R02_PARTY = "现金|ATM|柜员机|自动取款机"
R05_REPAYMENT = "还款|还借款|归还|偿还|借款归还|还钱"
R06_TRADE = "货款|服务费|借款|往来|工程款"
R07_CLOSURE = "销户|结清|转卡|换卡"
R08_INSURANCE_PARTY = "保险|人寿|财险|养老|保险经纪|保险代理"
R08_INSURANCE_SUMMARY = "保费|投保|续保|续期|趸交|期交|年金|寿险|万能险|分红险|银保|保单"
R08_SECURITIES_PARTY = "证券|基金|信托|期权|期货|财富|资产管理"
R08_SECURITIES_SUMMARY = "申购|认购|基金|第三方存管|银证转账|信托"
R08_WEALTH = "理财|大额存单"
R09_INCOME = "工资|薪酬|代发|奖金|劳务费|租金|分红|结息|货款"
R10_REPAYMENT = "还借款|还款|归还|偿还"
R10_LENDING = "借出|借给|出借|押金|保证金|代垫|暂借"
R11_NO_INCOME = "无(?:任何|固定|稳定)?收入|零收入|未取得收入"

#: what stands for an empty cell, any case
EMPTY_CELL = r"^(?:|[（(]空[）)]|无|--?|—|N/A|null)$"
#: printed forms of a direction
IN_WORDS = ("IN", "+", "收入", "转入", "贷", "贷方", "存入")
OUT_WORDS = ("OUT", "-", "支出", "转出", "借", "借方", "支取")
#: pattern in a bank cell, canonical name; tried in this order
BANK_CELLS = (
    ("工商银行|^工行", "中国工商银行"),
    ("农业银行|^农行", "中国农业银行"),
    ("建设银行|^建行$", "中国建设银行"),
    ("中国银行|^中行$", "中国银行"),
    ("光大银行", "中国光大银行"),
    ("邮政储蓄银行", "中国邮政储蓄银行"),
    ("民生银行", "中国民生银行"),
    ("兴业银行", "兴业银行"),
    ("平安银行", "平安银行"),
    ("绵阳农村商业银行", "四川绵阳农村商业银行"),
    ("绵阳市?商业银行|^绵商银行$", "绵阳市商业银行"),
)
#: names of banks in headers, and short forms of some
BANK_HEADERS = ("中国工商银行", "中国农业银行", "中国建设银行", "中国银行", "交通银行", "中国邮政储蓄银行", "中国光大银行", "招商银行", "中信银行", "兴业银行", "平安银行", "中国民生银行", "华夏银行", "浦发银行", "四川农信", "绵阳市商业银行")
BANK_SHORT = (("工商银行", "中国工商银行"), ("工行", "中国工商银行"), ("农业银行", "中国农业银行"), ("建设银行", "中国建设银行"), ("光大银行", "中国光大银行"))
BANK_GENERIC = "^(?:银行|商业银行|农村商业银行|信用社)$"
BANK_LEGAL_FORM = "股份有限公司|有限责任公司"

#: descriptions that name a type by themselves
DESCRIBED_TYPES = (
    ("费用", "手续费"), ("手续费", "手续费"), ("卡年费", "手续费"), ("小额费", "手续费"), ("汇费", "手续费"), ("短信服务", "手续费"), ("短信服务费", "手续费"),
    ("自动还款", "信用卡还款"), ("人民币自动转帐还款", "信用卡还款"), ("年费减免", "费用减免"), ("减免年费", "费用减免"), ("违约金", "违约金"), ("透支利息", "透支利息"),
    ("退款", "退款"), ("缴费", "缴费"), ("分期付款退货", "分期退款"), ("网络查控系统司法扣划", "司法扣划"), ("法院扣划", "司法扣划"), ("司法扣划", "司法扣划"),
    ("法院网络扣划", "司法扣划"), ("强制扣划", "司法扣划"), ("扣划", "司法扣划"),
)
#: type, direction, account kind, pattern of the description, pattern of the other party; the last that holds decides
DESCRIPTION_RULES = (
    ("存款结息", "", "deposit", "^(?:利息|结息|支付利息|利息收入|入息)$", ""),
    ("第三方支付", "", "deposit", "^快捷支付$", ""),
    ("贷款放款", "IN", "", "^(?:放款|贷款放款|个人贷款发放)(?:$|--|[：:])", ""),
    ("贷款还款", "OUT", "", "^还贷(?:$|[-—：:])|^[A-Z0-9]+还贷[-—]$", ""),
    ("贷款还款", "OUT", "", "个人贷款结息", ""),
    ("保险支出", "OUT", "", "", "保险(?:股份)?有限公司"),
    ("贷款放款", "IN", "", "^个人贷款$", ""),
    ("贷款还款", "OUT", "", "^个人贷款$", ""),
    ("分期转换", "", "", "^(?:账单分期|普通消费转分期)$", ""),
    ("分期", "", "", "^分期付款(?:到期扣收|利息)", ""),
)
PURCHASE, NO_PURCHASE = "消费", "转分期|利息"

CREDIT_REPAYMENT = "信用卡.{0,8}还款|贷记卡.{0,8}还款"
LOAN_REPAYMENT = "贷款还款|贷款本息|归还贷款|偿还贷款|还贷|个人贷款(?:每日扣款|结息)"
KNOWN_REPAYMENT = "^(?:自动还款|人民币自动转帐还款|微众银行还款)$"
PARTY_NUMBER = "^[0-9]{8,32}$"
#: type, basis, direction, account kind, pattern of the description, patterns of which each fits a piece of evidence,
#: whether the other party's account must be a number; the first that holds decides
PRINTED_RULES = (
    ("", "CONFLICTING_PRINTED_REPAYMENT_PURPOSES", "OUT", "", "", (CREDIT_REPAYMENT, LOAN_REPAYMENT), False),
    ("信用卡还款", "PRINTED_CREDIT_CARD_REPAYMENT_PURPOSE", "OUT", "", "", (CREDIT_REPAYMENT,), False),
    ("贷款还款", "PRINTED_LOAN_REPAYMENT_PURPOSE", "OUT", "", "", (LOAN_REPAYMENT,), False),
    ("消费", "PRINTED_REPAYMENT_KIND_UNRESOLVED", "OUT", "", "^消费$", ("还款",), False),
    ("", "PRINTED_REPAYMENT_KIND_UNRESOLVED", "OUT", "", "", ("还款",), False),
    ("分期退款", "PRINTED_INSTALLMENT_REFUND", "", "", "分期付款退货", (), False),
    ("退款", "PRINTED_PURCHASE_REFUND", "", "", "消费退货|消费退款|^退货$|^退款$", (), False),
    ("缴费", "EXPLICIT_UTILITY_TAX_OR_SOCIAL_CONTRIBUTION", "OUT", "deposit", "^(?:电费|水费|电话费|燃气费|个人所得税(?:等)?|社保费|用水费收水费|污水处理费收污水费|住房公积金(?:对公[0-9]+)?)$", (), False),
    ("缴费", "PRINTED_TELECOM_COLLECTION", "OUT", "deposit", "^实时代收$", ("^中国(?:电信|移动|联通)(?:股份)?有限公司(?:.{0,20}分公司)?$",), False),
    ("账户转账", "PRINTED_DISBURSEMENT_TO_COUNTERPARTY_ACCOUNT", "OUT", "deposit", "^(?:薪资[-—：:]|报销[-—：:]|日常报销费用(?:$|[-—：:])|(?:奖?助学金|津贴)[-—：:]|补贴[-—：:].*工资补助$|往来款$)", (), True),
    ("工资收入", "PRINTED_TRANSFER_WITH_EXPLICIT_WAGE_PURPOSE", "IN", "deposit", "^转账收入$", ("^工资(?:款|收入)?$",), False),
    ("工资收入", "PRINTED_PAYROLL_SETTLEMENT_CREDIT", "IN", "deposit", "^小额普通$", ("^代发工资业务待付结算款$",), False),
    ("账户转账", "PRINTED_CURRENT_ACCOUNT_PAYMENT_WITH_COUNTERPARTY_ACCOUNT", "IN OUT", "deposit", "^$", ("^往来款$",), True),
    ("账户转账", "EXPLICIT_DEPOSIT_TRANSFER_DESCRIPTION", "IN OUT", "deposit", "^(?:(?:跨行|行内|同行|网银|网上|手机银行)?转[账帐]|网转|他行汇入|跨行汇款|跨行转出|网银跨行汇款跨行转出|电子账户资金转出|网银转款本金|网银支付贷记|网银支付收到轧差通知|网银互联汇兑往账|超网汇兑[来往]账|汇兑往账[（(]直通[）)])$", (), False),
    ("现金存入", "PRINTED_CASH_DEPOSIT", "IN", "deposit", "^(?:现金存入|现金存款|存现|.{1,12}存现)$", (), False),
    ("现金支取", "PRINTED_CASH_WITHDRAWAL", "OUT", "deposit", "^(?:现金支取|现金取款|取现|.{1,12}取现)$", (), False),
    ("第三方支付", "PRINTED_PAYMENT_SETTLEMENT_OR_WALLET_WITHDRAWAL", "IN", "deposit", "^银联入账|^支付机构提现", (), False),
    ("第三方支付", "PRINTED_PAYMENT_SETTLEMENT_OR_WALLET_WITHDRAWAL", "IN", "deposit", "", ("(?:微信|零钱|余额宝|支付宝).{0,8}提现",), False),
    ("第三方支付", "PRINTED_QUICK_PAYMENT", "OUT", "deposit", "^(?:快捷支付|网上支付|网上快捷支付)", (), False),
    ("第三方支付", "PRINTED_PAYMENT_PROVIDER_CREDIT", "", "deposit", "^入金$", ("支付宝|财付通|微信|银联|支付有限公司|支付股份有限公司",), False),
    ("第三方支付", "PRINTED_PAYMENT_WALLET_TOPUP", "OUT", "deposit", "^充值$", ("(?:微信|支付宝|财付通|余额宝).{0,12}充值",), False),
)
#: type, direction, whole label in a merchant column of a deposit account
MERCHANT_LABELS = (
    ("工资收入", "IN", "^代发工资$"),
    ("第三方支付", "IN", "^银联入账$"),
    ("消费", "OUT", "^(?:支付宝|微信|财付通|银联)[-—－·:：]消费$"),
    ("账户转账", "IN", "^转账收入$"),
    ("账户转账", "OUT", "^转账支出$"),
)
DEPOSIT_INTEREST = "^(?:利息|结息|支付利息|利息收入|入息)$"

#: pages that hold no statement rows, or few
FEW_ROWS_PAGES = ("ACCOUNT_LIST", "ACCOUNT_INFO", "INVESTIGATION_ORDER", "BANK_REPLY", "COVER", "OTHER_DOCUMENT", "DOCUMENT")
HARD_FAILURE = r"连续识别失败|服务暂时不可用|未能完整获取|PDF\s*解析不完整"
UNASSIGNED_PAGES, UNASSIGNED_NAME = "待归属页面|待处理页面", "待归属页面"
#: milestone column, its label; those a case must have
MILESTONES = (
    ("t0", "T0 债务形成/借款日"),
    ("t1", "T1 诉讼立案/财产保全日"),
    ("t2", "T2 裁判文书生效日"),
    ("t3", "T3 执行立案日"),
    ("t4", "T4 《报告财产令》送达日"),
    ("t6", "T6 执行和解协议签署日"),
)
MILESTONE_ORDER = (("t0", "t1"), ("t1", "t2"), ("t2", "t3"), ("t3", "t4"), ("t3", "t6"))
#: rows that explain one another when a purchase is turned into instalments; PURCHASE is between
CONVERSION = "^(?:普通消费转分期|账单分期)$"
CONVERSION_COST, CONVERSION_INTEREST = "^(?:费用|消费[（(]利息[）)])$", "^消费[（(]利息[）)]$"
#: rows that empty an account
CLOSING = "销户|清户|销账|结清|冻结扣划|司法扣划|司法划扣|法院扣划|法院划扣"
#: bank names that name no certain bank
BANK_UNCERTAIN = "^(?:商业银行|商业银行股份有限公司)$"
#: what stands before an owner's name in a header
OWNER_LABEL = r"(?U)^(?:户名|客户姓名|账户名称|姓名)\s*[:：]?\s*"
#: part of a page above the rows, and that of the rows
PAGE_HEAD, PAGE_BODY = 0.16, 0.77

#: the fields of a statement row, in their order
STATEMENT_FIELDS = ("account_number", "account_name", "bank_name", "transaction_time", "transaction_date", "direction", "amount", "balance", "transaction_type", "counterparty_name", "counterparty_account", "counterparty_bank")
#: the types that a statement row can have
STATEMENT_TYPES = (
    "账户转账", "存款结息", "手续费", "工资收入", "司法扣划", "保险支出", "贷款放款", "贷款还款", "信用卡还款", "消费", "退款", "缴费", "第三方支付", "分期", "分期转换", "分期退款",
    "费用减免", "违约金", "透支利息", "现金存入", "现金支取",
)
#: types of rows in which the own bank is the other party
BANK_AS_PARTY_TYPES = ("手续费", "分期", "分期转换", "费用减免", "违约金", "透支利息", "存款结息")
#: headers of columns that name a type, and of those that only add to a description
TYPE_HEADERS = ("交易类型", "业务类型", "交易名称", "交易摘要", "摘要", "摘要代号", "摘要描述", "扩展用途", "用途", "交易备注", "附言", "交易地点/附言", "交易地点／附言")
MEMO_HEADERS = ("备注", "备注信息")
#: beginning of a header of the other party's columns
PARTY_HEADER = "^(?:对方|交易对手|收款方|付款方)"

#: headers of an amount's two sides, of an amount that may carry a sign, of descriptions in and beside a table, of account and name in one column
DEBIT_HEADER, CREDIT_HEADER = "^(?:借方发生额|借方金额|支出金额)$", "^(?:贷方发生额|贷方金额|收入金额)$"
PLAIN_AMOUNT_HEADER = "^(?:金额|交易金额|发生额|发生金额|交易发生额)$"
DESCRIPTION_HEADER, DETACHED_HEADER = "^(?:交易摘要|摘要|摘要代号|交易说明|交易描述|用途)$", "^(?:交易摘要|摘要|交易说明|用途)$"
COMBINED_PARTY_HEADER = "^(?:对方|交易对手)(?:账号|帐号)(?:与|及|和|[/／、])(?:户名|名称|姓名)$"

#: a holder or bank still to be confirmed, and what stands for a bank then
UNCONFIRMED, UNKNOWN_BANK, BANK_TO_CONFIRM = "待核验|未知", "待核验|未知|^商业银行$|^银行$", "待核验银行"

#: words of a summary that tell a direction, those of payments first
SUMMARY_OUT = "司法划扣|冻结扣划|扣划|消费|支取|取现|手续费|转出|汇款|扣款|代扣|缴费|贷款归还|还贷"
SUMMARY_IN = "结息|利息收入|工资|退款|退汇|存入|入账|收款|转入|还款|年费减免|费用减免"

#: what stands for a holder and for an account still to be confirmed; the latter goes on with the page
HOLDER_TO_CONFIRM, ACCOUNT_TO_CONFIRM = "待核验户名", "待核验账号-第"
