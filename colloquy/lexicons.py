"""Word lists and rules that results depend on, in the languages of the meetings."""

# Every list below is as given, in its natural order.

#: Words without content.
STOP_WORDS_ZH = (
    "的 是 在 和 了 有 我 他 她 它 这 那 什么 怎么 为什么 因为 所以 但是 一个 一些 这个 那个 这些 那些 我们 你们 他们 可以 可能 应该 需要 会 不会 能 不能 说 话 听 看 想 做 知道 觉得 认为 今天 明天 昨天 现在 刚才 然后 最后 首先 大家 一下 一直 "
    "那么 其实 关于 通过 进行 方面 情况 这样 那样 就是 还是 或者 而且 并且 以及 等 的话 起来 下来 出去 过来 过去 回来 回去 一点 一切 一边 一面 它们 她们 自己 别人 咱们 您们 这里 那里 哪里 到处 处处 怎样 多少 如何 不 着 过 地 得 吗 呢 吧 啊 哦 嗯 呀 哈 "
    "嘿 就 都 也 还 只 才 又 再 更 最 很 非常 特别 十分 比较 相当 极其 格外 已经 曾经 正在 将要 即将 马上 立刻 没有 没 别 莫 勿 休"
).split()

#: Words that every meeting has.
DOMAIN_STOP_WORDS_ZH = (
    "会议 内容 方面 问题 事情 东西 地方 时间 人员 情况 状态 方式 方法 过程 结果 原因 目的 大家 各位 领导 同事 今天 现在 然后 觉得 进行 通过 关于 对于 根据 按照 作为 为了 这个 那个 这些 那些 这样 那样 什么 怎么 我 你 他 她 我们 你们 他们 她们 自己 "
    "别人 本人 有人 一般 有点 一下 一些 一点 一直 一定 一样 可以 可能 应该 会 不会 能 不能 没有 没什么 小王 小张 小李 小刘 小陈 小杨 小黄 小吴 小赵 小钱 小孙 小周 小徐 小朱 小胡 小郭 小林 小马 小罗 小高 小郑 小梁 小宋 小唐"
).split()

#: Words without content, English.
STOP_WORDS_EN = (
    "the a an is are was were be been being have has had do does did will would could should may might must can shall need dare to of in for on with at "
    "by from up about into over after and but or as if when than because while although though that which who whom this these those it its meeting time "
    "people thing something anything"
).split()

#: Words without content in policy files.
PARSER_STOP_WORDS_ZH = (
    "的 是 在 和 了 有 我 他 她 它 这 那 什么 怎么 为什么 因为 所以 但是 一个 一些 这个 那个 这些 那些 我们 你们 他们 可以 可能 应该 需要 会 不会 能 不能 说 话 听 看 想 做 知道 觉得 认为 今天 明天 昨天 现在 刚才 然后 最后 首先 会议 内容 方面 "
    "问题 事情 东西 地方 时间 人员 情况 状态 方式 方法 过程 结果 原因 目的 大家 各位 领导 同事 进行 通过 关于 对于 根据 按照 作为 为了 一般 有点 一下 一点 一直 一定 一样 没有 没什么"
).split()

#: Parts of speech that keywords may have.
KEYWORD_TAGS = (
    "n nr ns nt nz v vn an a i l g"
).split()

#: Words before which a long sentence is split, tried in this order.
CUE_WORDS = [
    '我认为',
    '我觉得',
    '我建议',
    '我同意',
    '我强调',
    '我补充',
    '我指出',
    '我提出',
    '我想',
    '我打算',
    '我计划',
    '我准备',
    '我希望',
    '我要求',
    '我需要',
    '我必须',
    '另外，',
    '另外',
    '还有，',
    '还有',
    '对了，',
    '对了',
    '除此之外',
    '除此以外',
    '而且',
    '但是',
    '不过',
    '所以',
    '因此',
    '然而',
    '可是',
    '却',
    '反而',
    '第一，',
    '第一',
    '第二，',
    '第二',
    '第三，',
    '第三',
    '第四，',
    '第四',
    '第五，',
    '第五',
    '首先',
    '其次',
    '最后',
    '再次',
    '最后但并非最不重要',
    '好的，',
    '好的',
    '是的，',
    '是的',
    '明白，',
    '明白',
    '知道了，',
    '知道了',
    '必须',
    '要求',
    '禁止',
    '需要',
    '建议',
    '决定',
    '同意',
    '反对',
    '批准',
    '会议认为',
    '会议决定',
    '会议建议',
    '会议同意',
    '会议要求',
    '有观点认为',
    '有观点提出',
    '有人认为',
    '有人提出',
    '值得注意的是',
    '特别需要强调的是',
    '需要特别指出的是',
    '总而言之',
    '总的来说',
    '概括地说',
    '简单来说',
    '例如',
    '比如',
    '比如说',
    '举例来说',
    '正如',
    '也就是说',
    '换句话说',
    '具体而言',
    '更具体地说',
    '一方面',
    '另一方面',
    '从一方面来看',
    '从另一方面来看',
    '综上所述',
    '由此可见',
    '据此',
    '基于此',
    '事实上',
    '实际上',
    '其实',
    '本质上',
    '特别是',
    '尤其是',
    '更重要的是',
    '关键在于',
    '今天我们',
    '今天',
    '本周',
    '本月',
    '今年',
    '我们必须',
    '我们要求',
    '我们决定',
    '我们建议',
    '我们需要',
    '提醒客户',
    '提醒大家',
    '提醒各位',
    '公司',
    '产品',
    '项目',
    '市场',
    '业务',
    '技术',
    '发展',
    '合作',
    '创新',
    '管理',
    '服务',
    '质量',
    '风险',
    '合规',
    '规定',
    '制度',
    '政策',
    '规范',
    '销售',
    '客户',
    '竞争',
    '价格',
    '成本',
    '进度',
    '计划',
    '安排',
    '部署',
    '目标',
    '任务',
    '问题',
    '困难',
    '解决',
    '处理',
    '应对',
    '优化',
    '讨论',
    '分析',
    '研究',
    '评估',
    '检查',
    '审核',
    '汇报',
    '总结',
    '报告',
    '进展',
    '成果',
    '完成',
    '启动',
    '推进',
    '落实',
    '执行',
    '实施',
    '开展',
]

#: Openings that narration drops.
GREETINGS = [
    '^各位同事大家好[，,。.]?\\s*',
    '^大家好[，,。.]?\\s*',
    '^好的，谢谢大家[，,。.]?\\s*',
    '^谢谢大家[，,。.]?\\s*',
    '^好的[，,。.]\\s*',
    '^嗯[，,。.]\\s*',
    '^对[，,。.]\\s*',
    '^是[，,。.]\\s*',
    '^没错[，,。.]\\s*',
    '^行[，,。.]\\s*',
    '^可以[，,。.]\\s*',
    '^明白了[，,。.]\\s*',
    '^知道了[，,。.]\\s*',
]

#: Narration: what is rewritten after greetings, in this order.
NARRATIVE_FIRST = [
    ('今天我们来讨论', '会议讨论'),
    ('今天我们讨论', '会议讨论'),
    ('今天主要讲', '会议主要讨论'),
    ('今天主要说', '会议主要讨论'),
    ('我有个问题', '有观点提出疑问'),
    ('我有个疑问', '有观点提出疑问'),
    ('我想问一下', '有观点提出疑问'),
    ('我想请教', '有观点提出疑问'),
    ('^还有[，,，]?\\s*', ''),
    ('^另外[，,，]?\\s*', ''),
    ('^而且[，,，]?\\s*', ''),
    ('^但是[，,，]?\\s*', ''),
    ('^不过[，,，]?\\s*', ''),
    ('^那么[，,，]?\\s*', ''),
    ('^所以[，,，]?\\s*', ''),
    ('^因此[，,，]?\\s*', ''),
    ('^因为[，,，]?\\s*', ''),
    ('^其实[，,，]?\\s*', ''),
    ('^然后[，,，]?\\s*', ''),
    ('^接下来[，,，]?\\s*', ''),
    ('^首先[，,，]?\\s*', ''),
    ('^其次[，,，]?\\s*', ''),
    ('^最后[，,，]?\\s*', ''),
    ('^还有', ''),
    ('^另外', ''),
    ('^而且', ''),
    ('^但是', ''),
    ('^不过', ''),
    ('^那么', ''),
    ('^所以', ''),
    ('^因此', ''),
    ('^因为', ''),
    ('^其实', ''),
    ('^然后', ''),
    ('^接下来', ''),
]

#: Narration: first person to third.
NARRATIVE_ROLES = [
    ('我们公司', '公司'),
    ('咱们公司', '公司'),
    ('我个人认为', '有观点认为'),
    ('我个人觉得', '有观点认为'),
    ('我个人建议', '建议'),
    ('我认为', '有观点认为'),
    ('我觉得', '有观点认为'),
    ('我看', '有观点认为'),
    ('我想', '有观点提出'),
    ('我建议', '建议'),
    ('我提议', '提议'),
    ('我同意', '同意'),
    ('我不同意', '不同意'),
    ('我反对', '反对'),
    ('我支持', '支持'),
    ('我强调', '强调'),
    ('我们认为', '会议认为'),
    ('我们觉得', '会议认为'),
    ('我们建议', '会议建议'),
    ('我们提议', '会议提议'),
    ('我们决定', '会议决定'),
    ('我们同意', '会议同意'),
    ('我们反对', '会议反对'),
    ('我们强调', '会议强调'),
    ('我们需要', '需要'),
    ('我们必须', '必须'),
    ('我们应当', '应当'),
    ('我们应该', '应该'),
    ('我们禁止', '禁止'),
    ('我们要求', '要求'),
    ('我们明确', '明确'),
    ('我说', '发言称'),
    ('他说', '发言称'),
    ('她说', '发言称'),
    ('大家说', '参会人员表示'),
    ('大家认为', '参会人员认为'),
    ('大家觉得', '参会人员认为'),
    ('各位同事', '参会人员'),
    ('各位领导', '参会人员'),
    ('同事们', '参会人员'),
    ('大家好', ''),
    ('大家', '参会人员'),
    ('咱们', '参会人员'),
    ('我们', '会议'),
    ('我', '发言者'),
]

#: Narration: repeats and commas.
NARRATIVE_LAST = [
    ('发言者们', '参会人员'),
    ('参会人员参会人员', '参会人员'),
    ('发言者发言者', '发言者'),
    ('会议会议', '会议'),
    ('公司公司', '公司'),
    ('[“”"\\\']', ''),
    ('([\\u4e00-\\u9fa5])\\1{2,}', '\\1'),
    ('([\\u4e00-\\u9fa5]{2,})\\1{1,}', '\\1'),
    ('，而且', '，'),
    ('，不过', '，但'),
    ('，那么', '，'),
    ('，所以', '，因此'),
]

#: What a summary sentence does not begin with.
SUMMARY_OPENINGS = [
    '^好的[，,。.\\s]*',
    '^对[，,。.\\s]*',
    '^是[，,。.\\s]*',
    '^没错[，,。.\\s]*',
    '^明白[了的]*[，,。.\\s]*',
    '^知道了[，,。.\\s]*',
    '^嗯[，,。.\\s]*',
    '^哦[，,。.\\s]*',
    '^行[，,。.\\s]*',
    '^可以[，,。.\\s]*',
    '^还有[，,。.\\s]*',
    '^另外[，,。.\\s]*',
    '^而且[，,。.\\s]*',
    '^但是[，,。.\\s]*',
    '^不过[，,。.\\s]*',
    '^那么[，,。.\\s]*',
    '^所以[，,。.\\s]*',
    '^因此[，,。.\\s]*',
    '^因为[，,。.\\s]*',
    '^其实[，,。.\\s]*',
    '^然后[，,。.\\s]*',
    '^接下来[，,。.\\s]*',
    '^首先[，,。.\\s]*',
    '^其次[，,。.\\s]*',
    '^最后[，,。.\\s]*',
    '^关于[这那]个[，,。.\\s]*',
]

#: What a summary sentence does not end with.
SUMMARY_ENDINGS = [
    '[，,、；;]\\s*$',
    '[这那][个样种]*$',
    '的话$',
    '什么的$',
    '等等$',
    '之类$',
]

#: Summary sentences: repeats, signs and phrases.
SUMMARY_PHRASES = [
    ('([\\u4e00-\\u9fa5])\\1{2,}', '\\1'),
    ('([\\u4e00-\\u9fa5]{2,})\\1{1,}', '\\1'),
    ('[，,]{2,}', '，'),
    ('[。.]{2,}', '。'),
    ('[、]{2,}', '、'),
    ('讨论一下', '讨论'),
    ('说一下', '说明'),
    ('讲一下', '讲解'),
    ('看一下', '查看'),
    ('对了[，,]*', ''),
    ('产品的产品', '产品'),
    ('风险等级是是', '风险等级是'),
    ('会议会议', '会议'),
    ('销售人员销售人员', '销售人员'),
    ('参会人员参会人员', '参会人员'),
    ('发言者发言者', '发言者'),
    ('公司公司', '公司'),
]

#: Patterns of sentences that say nothing.
SMALL_TALK = [
    '^好的$',
    '^谢谢',
    '^大家好',
    '^散会',
    '^明白了',
    '^知道了',
    '还有什么问题',
    '没什么问题',
    '没了',
    '没有了',
    '^没问题',
    '^可以$',
    '^行$',
    '^对$',
    '^是$',
    '^没错$',
    '今天就到这里',
    '今天就到这儿',
    '感谢.*参与',
    '谢谢大家',
    '暂时没有',
    '有问题.*沟通',
]

#: Words of questions.
QUESTION_WORDS = (
    "怎么 什么 谁 哪 几 多少 为什么 是否 吗 呢"
).split()

#: Patterns of sentences without a point.
EMPTY_PATTERNS = [
    '^好的$',
    '^谢谢$',
    '^大家好$',
    '^明白了$',
    '^知道了$',
    '^没问题$',
    '^可以$',
    '^行$',
    '^对$',
    '^是$',
    '还有什么问题',
    '没什么问题',
    '没了',
    '没有了',
    '散会',
    '结束',
]

#: Signs of discussion.
DISCUSSION_PATTERNS = [
    '讨论',
    '认为',
    '强调',
    '指出',
    '提出',
    '表示',
    '觉得',
    '分析',
    '探讨',
    '研究',
    '关注',
    '重视',
    '考虑',
    '问题',
    '难点',
    '重点',
    '核心',
    '关键',
    '会议认为',
    '有观点认为',
    '发言称',
    '参会人员',
]

#: Signs of a rule.
NORMATIVE_PATTERNS = [
    '禁止',
    '不得',
    '必须',
    '应当',
    '要求',
    '严禁',
    '需要',
    '明确',
    '强调',
    '决定',
    '同意',
    '反对',
]

#: Promises that may not be made.
PROMISE_PATTERNS = [
    '承诺.*保本',
    '承诺.*收益',
    '保证.*收益',
    '保证.*保本',
    '绝对安全',
    '无风险',
    '零风险',
    '稳赚不赔',
    '放心推荐',
    '肯定赚',
    '一定赚',
]

#: Signs of invented news.
NEWS_PATTERNS = [
    '周[一二三四五六日]\\(',
    '\\d+月\\d+日',
    '《[^》]+》',
    '报道',
    '网络版',
    '记者',
    '消息人士',
    '央行',
    '证监会',
    '银保监',
]

#: Action items; the brackets are character classes.
ACTION_PATTERNS_ZH = [
    '[需要必须应该要求][^。！？]*[。！？]',
    '[决定决议同意批准][^。！？]*[。！？]',
    '[负责跟进落实执行][^。！？]*[。！？]',
    '[计划预计安排][^。！？]*[。！？]',
    '[下周下月近期][^。！？]*[。！？]',
]

#: Action items, English.
ACTION_PATTERNS_EN = [
    '[Nn]eed to[^.!?]*[.!?]',
    '[Mm]ust[^.!?]*[.!?]',
    '[Ss]hould[^.!?]*[.!?]',
    '[Dd]ecide[^.!?]*[.!?]',
    '[Pp]lan[^.!?]*[.!?]',
]

#: Topics and their words.
TOPICS = {
    '工作汇报': '汇报 总结 报告 完成 进展 成果 回顾 梳理 概况 数据'.split(),
    '项目讨论': '项目 方案 设计 开发 实施 规划 推进 启动 阶段 里程碑'.split(),
    '问题解决': '问题 困难 解决 处理 应对 排除 修复 改善 优化 突破'.split(),
    '决策制定': '决定 决策 批准 同意 通过 审议 表决 决议 采纳 确认'.split(),
    '进度跟进': '进度 进展 跟进 更新 状态 检查 追踪 督办 落实 执行'.split(),
    '计划安排': '计划 安排 规划 部署 排期 时间表 日程 路线图 目标 任务'.split(),
    '意见交流': '意见 建议 讨论 交流 想法 看法 观点 反馈 提议 倡议'.split(),
    '培训学习': '培训 学习 课程 讲座 知识 教学 指导 培训 分享 研讨'.split(),
    '风险讨论': '风险 隐患 问题 预警 管控 防范 评估 识别 应对 控制'.split(),
    '合规审查': '合规 规定 制度 政策 规范 标准 要求 检查 审核 遵从'.split(),
    '财务预算': '预算 费用 成本 支出 收入 资金 财务 报销 拨款 核算'.split(),
    '人事安排': '人员 招聘 分配 调动 任命 职责 团队 岗位 编制 考核'.split(),
    '客户服务': '客户 服务 满意度 需求 反馈 投诉 售后 维护 回访 支持'.split(),
    '产品设计': '产品 设计 功能 体验 界面 需求 原型 测试 迭代 用户'.split(),
    '技术方案': '技术 架构 系统 方案 实现 接口 模块 部署 性能 优化'.split(),
    '市场营销': '市场 营销 推广 品牌 宣传 渠道 客户 销售 策略 活动'.split(),
}

#: Topics and their words, short form.
TOPICS_SHORT = {
    '工作汇报': '汇报 总结 报告 完成 进展 成果'.split(),
    '项目讨论': '项目 方案 设计 开发 实施 推进'.split(),
    '问题解决': '问题 困难 解决 处理 应对 修复'.split(),
    '决策制定': '决定 决策 批准 同意 通过 决议'.split(),
    '进度跟进': '进度 进展 跟进 更新 状态 追踪'.split(),
    '计划安排': '计划 安排 规划 部署 排期 目标'.split(),
    '意见交流': '意见 建议 讨论 交流 想法 反馈'.split(),
    '培训学习': '培训 学习 课程 讲座 知识 研讨'.split(),
    '风险讨论': '风险 隐患 预警 管控 防范 评估'.split(),
    '合规审查': '合规 规定 制度 政策 规范 审核'.split(),
    '财务预算': '预算 费用 成本 支出 资金 财务'.split(),
    '人事安排': '人员 招聘 分配 调动 任命 职责'.split(),
}

#: Weights of words in favour.
POSITIVE_WORDS = {
    '好': 1,
    '优秀': 2,
    '完成': 1,
    '成功': 2,
    '进步': 1,
    '提升': 1,
    '积极': 1,
    '满意': 2,
    '支持': 1,
    '同意': 1,
    '通过': 1,
    '批准': 1,
    '赞': 1,
    '赞成': 1,
    '顺利': 1,
    '突破': 2,
    '创新': 1,
    '高效': 1,
    '优化': 1,
    '改善': 1,
    '增长': 1,
    '盈利': 1,
    '超越': 1,
    '达成': 1,
    '实现': 1,
    '解决': 1,
    '加强': 1,
    '推进': 1,
    '落实': 1,
    '成效': 1,
    '成果': 1,
    '收获': 1,
    '确认': 1,
    '明确': 1,
    '完善': 1,
    '规范': 1,
    '保障': 1,
    '确保': 1,
}

#: Weights of words against.
NEGATIVE_WORDS = {
    '消极': 1,
    '反对': 1,
    '抵制': 2,
    '抱怨': 1,
    '不满': 1,
    '拒绝': 1,
    '不行': 1,
    '不可能': 1,
    '做不到': 1,
    '失败': 2,
    '延误': 1,
    '延迟': 1,
    '隐患': 1,
    '困难': 1,
    '障碍': 1,
    '阻碍': 1,
    '下降': 1,
    '减少': 1,
    '亏损': 2,
    '流失': 1,
    '违规': 2,
    '违纪': 2,
    '偏离': 1,
    '不当': 1,
    '不足': 1,
    '缺乏': 1,
    '缺失': 1,
    '遗漏': 1,
    '忽悠': 2,
    '骗': 2,
    '蒙': 2,
    '糊弄': 2,
    '坑': 2,
    '麻烦': 1,
    '混乱': 1,
    '糟': 1,
}

#: Words without a side.
NEUTRAL_WORDS = (
    "风险 问题 讨论 分析 评估 检查 审核 要求 规定 制度 政策 规范 标准 禁止 必须 应该 需要 建议 决定 培训 学习 会议 沟通 交流 意见"
).split()

#: Words that turn the next.
NEGATION_WORDS = (
    "不 没 无 非 未 别 莫 勿 否"
).split()

#: Factors of words of degree.
DEGREE_WORDS = {'非常': 1.5, '十分': 1.5, '特别': 1.5, '极其': 2, '格外': 1.5, '比较': 1.2, '相当': 1.3, '很': 1.2, '太': 1.5, '极为': 2}

#: Words before a keyword that take its risk away.
NEGATED_CONTEXT = (
    "禁止 不得 不能 不要 严禁 不允许 不可以 不准 反对 拒绝 纠正 不对 错误 不应该 不应当 必须避免 不能有 不允许有 禁止使用 禁止承诺 不允许承诺 不得承诺 不得使用 不可 千万别 绝对不能 一定不要 坚决禁止 严格禁止"
).split()

#: Patterns of risky statements: (pattern, category, severity).
RISK_RULES = [
    ('肯定会赚|一定赚|稳赚|保本保收益|零风险|无风险|绝对安全', '表述不当', 'high'),
    ('忽悠|骗|蒙|糊弄|坑', '表述不当', 'high'),
    ('随便说说|无所谓|不用管', '表述不当', 'medium'),
    ('不行吧|不太可能|估计悬', '消极负面', 'medium'),
    ('太麻烦了|不想做|懒得弄', '消极负面', 'medium'),
    ('这东西没用|没必要|浪费时间', '消极负面', 'high'),
    ('客户傻|客户不懂|客户好忽悠', '表述不当', 'high'),
    ('上级不知道|领导不会查|没人知道', '表述不当', 'high'),
    ('问题太多|麻烦不断|一团糟|混乱', '消极负面', 'high'),
    ('没办法|无解|搞不定|束手无策', '消极负面', 'medium'),
    ('不乐观|堪忧|危险|隐患', '消极负面', 'medium'),
    ('反对意见|抵制|拒绝执行', '消极负面', 'high'),
    ('抱怨|不满|牢骚|指责', '消极负面', 'medium'),
]

#: Parts of keywords of high severity.
HIGH_RISK_WORDS = (
    "抵制 反对 拒绝 消极 不满"
).split()

#: Parts of keywords of medium severity.
MEDIUM_RISK_WORDS = (
    "抱怨 不行 不可能 做不到"
).split()

#: Words before which a comma goes, in this order.
COMMA_BEFORE = [
    '并且',
    '而且',
    '但是',
    '不过',
    '然而',
    '可是',
    '却',
    '反而',
    '倒是',
    '因此',
    '所以',
    '因而',
    '于是',
    '从而',
    '以致',
    '因为',
    '由于',
    '既然',
    '要是',
    '如果',
    '假如',
    '倘若',
    '万一',
    '除非',
    '虽然',
    '尽管',
    '即使',
    '哪怕',
    '纵然',
    '只要',
    '只有',
    '无论',
    '不管',
    '不论',
    '不仅',
    '不但',
    '不光',
    '不只',
    '还是',
    '或是',
    '或者',
    '以及',
    '及',
    '与',
    '和',
    '跟',
    '另外',
    '此外',
    '再者',
    '还有',
    '同时',
    '另外还有',
    '第一',
    '第二',
    '第三',
    '第四',
    '第五',
    '首先',
    '其次',
    '最后',
    '再次',
    '那么',
    '这么',
    '那样',
    '这样',
    '其实',
    '事实上',
    '实际上',
    '本质上',
    '简单来说',
    '总而言之',
    '总的来说',
    '概括地说',
    '例如',
    '比如',
    '比如说',
    '举例来说',
    '特别是',
    '尤其是',
    '值得注意的是',
    '也就是说',
    '换句话说',
    '具体而言',
    '一方面',
    '另一方面',
    '综上所述',
    '由此可见',
    '据此',
    '我们认为',
    '我们觉得',
    '我们建议',
    '我们决定',
    '我们需要',
    '会议认为',
    '会议决定',
    '会议建议',
    '有观点认为',
    '有观点提出',
]

#: Words after which a comma goes, in this order.
COMMA_AFTER = [
    '的话',
    '之后',
    '之前',
    '以来',
    '以来的',
    '今天',
    '明天',
    '昨天',
    '前天',
    '后天',
    '现在',
    '刚才',
    '刚刚',
    '之前',
    '以后',
    '目前',
    '当前',
    '近来',
    '最近',
    '同时',
    '与此同时',
    '一起',
    '一同',
    '总之',
    '总而言之',
    '总之来说',
    '最后',
    '最终',
    '终于',
    '结果',
    '结论',
    '因此',
    '首先',
    '其次',
    '再次',
    '最后',
    '第一',
    '第二',
    '第三',
    '例如',
    '比如',
    '事实上',
    '实际上',
    '其实',
    '另外',
    '此外',
    '不过',
    '但是',
    '然而',
    '因此',
    '所以',
]

#: Particles that end a question.
QUESTION_PARTICLES = (
    "吗 呢 吧 啊 呀 嘛 咯 哦 嘿 诶 哼 嗯 哈"
).split()

#: Particles that end a sentence.
STOP_PARTICLES = (
    "了 的 吧 呢 吗 啊 呀 嘛"
).split()

