"""The hand-written questions and answers that the customer-service corpus starts from."""

# Intent, question, answer, keywords; intent "ood" is out of domain.  In their own order.
SEEDS = (
    ("price", "经典珍珠奶茶多少钱?", "经典珍珠奶茶 12 元一杯。", ("12",)),
    ("price", "杨枝甘露什么价位?", "杨枝甘露 18 元一杯。", ("18",)),
    ("price", "你们最便宜的是什么?", "茉莉绿茶最便宜,8 元一杯。", ("茉莉绿茶", "8")),
    ("price", "芝士奶盖四季春贵不贵?", "芝士奶盖四季春 16 元一杯。", ("16",)),
    ("price", "加珍珠要加钱吗?", "加珍珠加 2 元,其他小料椰果 2 元、芋泥 3 元、奶盖 4 元、布丁 3 元。", ("2",)),
    ("price", "芋泥波波鲜奶卖多少?", "芋泥波波鲜奶 17 元一杯。", ("17",)),
    ("price", "黑糖珍珠鲜奶的价格?", "黑糖珍珠鲜奶 15 元一杯。", ("15",)),
    ("price", "柠檬气泡水多少钱?", "柠檬气泡水 10 元一杯。", ("10",)),
    ("price", "焦糖布丁奶茶呢?", "焦糖布丁奶茶 14 元一杯。", ("14",)),
    ("price", "茉莉绿茶多少钱?", "茉莉绿茶 8 元一杯。", ("8",)),
    ("recommend", "有什么好喝的吗?", "推荐杨枝甘露,芒果西柚配西米,酸甜清爽,是招牌。", ("杨枝甘露",)),
    ("recommend", "想喝奶茶,推荐什么?", "经典珍珠奶茶最受欢迎,12 元一杯;喜欢浓郁可以试黑糖珍珠鲜奶。", ("经典珍珠奶茶", "黑糖珍珠鲜奶")),
    ("recommend", "有没有不含茶的饮品?", "柠檬气泡水和黑糖珍珠鲜奶都不含茶,可以放心选。", ("柠檬气泡水", "黑糖珍珠鲜奶")),
    ("recommend", "我想喝带芝士的,推荐?", "芝士奶盖四季春 16 元,奶盖咸香,茶底清爽。", ("芝士奶盖四季春",)),
    ("recommend", "哪个是招牌?", "招牌是杨枝甘露和经典珍珠奶茶,点单最多。", ("杨枝甘露", "经典珍珠奶茶")),
    ("recommend", "有什么适合夏天的?", "夏天推荐柠檬气泡水和杨枝甘露,清爽解暑。", ("柠檬气泡水", "杨枝甘露")),
    ("recommend", "喜欢芋泥,有什么?", "芋泥波波鲜奶 17 元,芋泥绵密配鲜奶,很受欢迎。", ("芋泥波波鲜奶",)),
    ("recommend", "不想喝甜的,有什么?", "茉莉绿茶清爽不甜,还可以选无糖,8 元一杯。", ("茉莉绿茶",)),
    ("recommend", "有给小朋友喝的吗?", "柠檬气泡水和茉莉绿茶比较清淡,也可以做去冰少糖。", ("柠檬气泡水", "茉莉绿茶")),
    ("customize", "可以选糖度吗?", "可以,糖度分正常、少糖、半糖、三分甜和无糖。", ("无糖", "半糖")),
    ("customize", "能去冰吗?", "可以,冰量可选正常、少冰、去冰,部分饮品可以做热的。", ("去冰", "少冰")),
    ("customize", "珍珠奶茶能做无糖吗?", "可以,任何奶茶都可以选无糖,珍珠本身带一点甜味。", ("无糖",)),
    ("customize", "可以加奶盖吗?", "可以,加奶盖加 4 元。", ("4",)),
    ("customize", "能做成热饮吗?", "部分饮品可以做热的,比如经典珍珠奶茶和芋泥波波鲜奶。", ("经典珍珠奶茶", "芋泥波波鲜奶")),
    ("hours", "你们几点开门?", "我们早上 10:00 开门营业。", ("10:00", "10")),
    ("hours", "营业到几点?", "营业到晚上 22:00,外卖 21:30 截止。", ("22:00", "21:30")),
    ("hours", "现在这个点还营业吗?", "我们营业时间是 10:00-22:00,您看下当前时间。", ("10:00", "22:00")),
    ("hours", "周末营业吗?", "周末和节假日正常营业,10:00-22:00。", ("10:00", "22:00")),
    ("delivery", "可以点外卖吗?", "可以,3 公里内配送,满 25 元免配送费,不满收 3 元配送费。", ("3", "25")),
    ("delivery", "配送费多少钱?", "配送费 3 元,满 25 元免配送费。", ("3", "25")),
    ("delivery", "外卖几点截止?", "外卖 21:30 截止下单。", ("21:30",)),
    ("delivery", "配送范围多远?", "门店 3 公里内配送。", ("3",)),
    ("member", "怎么积分?", "消费 1 元积 1 分,100 积分可以抵 5 元。", ("1", "100", "5")),
    ("member", "积分有什么用?", "积分可以在结账时抵扣,100 积分抵 5 元。", ("100", "5")),
    ("member", "有优惠券吗?", "新客注册立减 3 元,每周三第二杯半价。", ("3", "半价")),
    ("member", "怎么成为会员?", "在小程序注册即可成为会员,新客立减 3 元。", ("小程序", "3")),
    ("member", "周三有什么活动?", "每周三第二杯半价。", ("半价",)),
    ("after_sale", "不好喝可以换吗?", "出品 30 分钟内口味不满意,可以免费重做或退款。", ("30", "重做", "退款")),
    ("after_sale", "外卖洒了怎么办?", "外卖洒漏或破损,拍照联系客服可退款。", ("拍照", "退款")),
    ("after_sale", "能退款吗?", "30 分钟内口味不满意可退,外卖破损可退。", ("30", "退款")),
    ("allergen", "杨枝甘露里有芒果吗?", "有的,杨枝甘露含芒果,对芒果过敏的话不建议饮用。", ("芒果",)),
    ("allergen", "有含牛奶的饮品吗?", "黑糖珍珠鲜奶、芋泥波波鲜奶、芝士奶盖都含乳制品。", ("黑糖珍珠鲜奶", "芋泥波波鲜奶")),
    ("allergen", "哪款不含奶?", "茉莉绿茶、柠檬气泡水、杨枝甘露不含牛奶。", ("茉莉绿茶", "柠檬气泡水")),
    ("store", "附近有门店吗?", "全国有 200 多家门店,可以在小程序里查看最近的门店。", ("200", "小程序")),
    ("store", "有 WiFi 吗?", "门店提供免费 WiFi。", ("WiFi",)),
    ("store", "你们是什么品牌?", "茶语时光 2019 年创立,主打新鲜现做茶饮,全国 200 多家门店。", ("2019", "200")),
    ("store", "怎么找最近的门店?", "打开茶语时光小程序,可以定位并查看最近门店。", ("小程序",)),
    ("ood", "你们能修手机吗?", "抱歉,我是茶语时光的客服,只负责店内产品和服务相关问题,这个问题我无法回答。", ("抱歉", "无法回答")),
    ("ood", "推荐一只股票?", "抱歉,这个问题超出了我的服务范围,我是茶语时光客服,只解答店内业务。", ("抱歉", "服务范围")),
    ("ood", "帮我查一下明天北京的天气", "抱歉,我是茶语时光的客服,只负责门店产品、营业时间、会员优惠和售后相关问题,这个问题我无法回答。", ("抱歉", "无法回答")),
    ("ood", "附近哪里可以租房?", "不好意思,这个问题超出了我的服务范围,建议您咨询相关专业渠道。", ("不好意思", "服务范围")),
    ("ood", "你们招人吗?", "抱歉,我是茶语时光的客服,招聘问题请联系我们的官方招聘渠道。", ("抱歉", "招聘")),
    ("ood", "帮我写一篇论文", "抱歉,这个问题超出了我的服务范围,我是茶语时光客服,只解答店内业务。", ("抱歉", "服务范围")),
    ("ood", "怎么炒股?", "抱歉,我是茶语时光的客服,只负责门店产品和服务相关问题,这个问题我无法回答。", ("抱歉", "无法回答")),
    ("ood", "你们家能充话费吗?", "抱歉,我是茶语时光的客服,只负责店内产品和服务相关问题,这个问题我无法回答。", ("抱歉", "无法回答")),
)
