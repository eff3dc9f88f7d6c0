"""Words of three languages: what people call things, and what replies call them. Tables only."""

# fixed values: what English calls the objects
OBJECTS = {
    "bottle": ["bottle", "water bottle", "flask", "thermos", "tumbler"],
    "backpack": ["backpack", "bag", "rucksack", "knapsack", "schoolbag"],
    "laptop": ["laptop", "macbook", "computer", "notebook computer"],
    "notebook": ["notebook", "notepad", "note book", "writing pad"],
    "book": ["book", "textbook"],
    "phone": ["phone", "smartphone", "mobile", "cellphone", "iphone"],
    "charger": ["charger", "adapter", "power adapter", "charging brick"],
    "cable": ["cable", "cord", "wire", "usb cable", "charging cable"],
    "mug": ["mug", "cup", "coffee cup", "tea cup"],
    "keys": ["keys", "key", "keychain", "keyring"],
    "wallet": ["wallet", "purse", "billfold"],
    "umbrella": ["umbrella"],
    "headphones": ["headphones", "earphones", "earbuds", "headset", "airpods"],
    "glasses": ["glasses", "eyeglasses", "spectacles", "sunglasses"],
    "mouse": ["mouse", "computer mouse"],
    "pen": ["pen", "pencil", "marker"],
    "card": ["card", "id card", "student card", "badge", "lanyard"],
    "tumbler": ["tumbler", "flask"],
    "power bank": ["power bank", "powerbank", "battery", "portable charger", "external battery"],
    "tablet": ["tablet", "ipad"],
    "watch": ["watch", "smartwatch"],
    "skateboard": ["skateboard", "board"],
    "tissue": ["tissue", "napkin", "serviette", "paper towel", "kitchen roll", "toilet paper", "wet wipe", "kleenex", "loo roll", "baby wipe"],
    "fan": ["fan", "hand fan", "handheld fan", "handled fan", "mini fan", "portable fan", "usb fan", "electric fan"],
    "hair tie": ["hair tie", "hairtie", "scrunchie", "hair band", "hairband", "hair elastic", "bobble", "ponytail holder"],
}
# fixed values: what Korean and Chinese call the objects
OBJECTS_CJK = {
    "bottle": ["물병", "보틀", "텀블러", "병", "水瓶", "瓶子", "保温杯"],
    "backpack": ["가방", "백팩", "책가방", "包", "背包", "书包", "袋子"],
    "laptop": ["노트북", "랩탑", "맥북", "笔记本", "电脑", "笔记本电脑"],
    "phone": ["폰", "핸드폰", "휴대폰", "스마트폰", "手机", "电话"],
    "charger": ["충전기", "어댑터", "充电器", "适配器"],
    "cable": ["케이블", "충전선", "선", "数据线", "充电线", "线"],
    "mug": ["머그", "머그컵", "컵", "杯子", "马克杯", "水杯"],
    "keys": ["열쇠", "키링", "钥匙", "钥匙扣"],
    "wallet": ["지갑", "钱包"],
    "umbrella": ["우산", "雨伞", "伞"],
    "headphones": ["이어폰", "에어팟", "헤드폰", "이어버즈", "耳机", "耳塞"],
    "glasses": ["안경", "선글라스", "眼镜", "墨镜"],
    "mouse": ["마우스", "鼠标"],
    "pen": ["볼펜", "연필", "笔", "铅笔"],
    "watch": ["시계", "스마트워치", "手表", "腕表"],
    "tablet": ["태블릿", "아이패드", "平板"],
    "book": ["책", "书", "书本"],
    "power bank": ["보조배터리", "充电宝", "移动电源"],
    "card": ["카드", "명함", "卡", "名片"],
    "fan": ["선풍기", "손선풍기", "미니선풍기", "휴대용선풍기", "부채", "风扇", "手持风扇", "小风扇", "手持小风扇", "电风扇", "扇子"],
    "tissue": ["휴지", "티슈", "냅킨", "물티슈", "纸巾", "抽纸", "面巾纸", "湿巾"],
    "hair tie": ["머리끈", "곱창밴드", "헤어끈", "머리띠", "发圈", "发绳", "皮筋"],
    "case": ["케이스", "파우치", "盒子", "收纳盒"],
    "skateboard": ["스케이트보드", "보드", "滑板"],
}
# fixed values: colours in Korean and Chinese
COLORS_CJK = {
    "검정": "black", "검은": "black", "까만": "black", "블랙": "black", "黑": "black", "黑色": "black",
    "흰": "white", "하얀": "white", "화이트": "white", "白": "white", "白色": "white",
    "회색": "gray", "灰": "gray", "灰色": "gray", "은색": "silver", "실버": "silver", "银": "silver", "银色": "silver",
    "빨간": "red", "빨강": "red", "레드": "red", "红": "red", "红色": "red", "주황": "orange", "오렌지": "orange", "橙": "orange", "橙色": "orange",
    "노란": "yellow", "노랑": "yellow", "黄": "yellow", "黄色": "yellow",
    "초록": "green", "녹색": "green", "그린": "green", "민트": "green", "绿": "green", "绿色": "green",
    "파란": "blue", "파랑": "blue", "블루": "blue", "남색": "blue", "蓝": "blue", "蓝色": "blue",
    "보라": "purple", "퍼플": "purple", "紫": "purple", "紫色": "purple",
    "분홍": "pink", "핑크": "pink", "粉": "pink", "粉色": "pink", "粉红": "pink", "粉红色": "pink",
    "갈색": "brown", "브라운": "brown", "棕": "brown", "棕色": "brown", "베이지": "beige", "米色": "beige",
    "금색": "gold", "골드": "gold", "金": "gold", "金色": "gold", "투명": "transparent", "透明": "transparent",
}
# fixed values: spellings of objects in requests
MISSPELLED = {
    "botle": "bottle", "bottel": "bottle", "bttle": "bottle", "labtop": "laptop", "lap top": "laptop", "mac book": "laptop",
    "chargre": "charger", "chager": "charger", "adaptor": "charger", "usb": "cable", "cabel": "cable", "kyes": "keys", "key chain": "keys",
}
# fixed values: traditional characters and the simplified ones for them
TRADITIONAL = {
    "佈": "布", "來": "来", "個": "个", "傘": "伞", "備": "备", "內": "内", "剋": "克", "動": "动", "嗎": "吗", "圍": "围", "寶": "宝", "對": "对",
    "屬": "属", "張": "张", "彔": "录", "後": "后", "憑": "凭", "應": "应", "捱": "挨", "擋": "挡", "據": "据", "攝": "摄", "數": "数", "書": "书",
    "會": "会", "東": "东", "樓": "楼", "標": "标", "機": "机", "沒": "没", "準": "准", "溫": "温", "溼": "湿", "濕": "湿", "為": "为", "爲": "为",
    "發": "发", "盃": "杯", "確": "确", "筆": "笔", "箇": "个", "範": "范", "紅": "红", "納": "纳", "紙": "纸", "綠": "绿", "綫": "线", "緊": "紧",
    "緑": "绿", "線": "线", "繩": "绳", "羅": "罗", "聽": "听", "腦": "脑", "藍": "蓝", "衕": "同", "裏": "里", "裡": "里", "覈": "核", "記": "记",
    "話": "话", "該": "该", "說": "说", "説": "说", "請": "请", "議": "议", "質": "质", "這": "这", "過": "过", "適": "适", "還": "还", "邊": "边",
    "釦": "扣", "鈅": "钥", "鉛": "铅", "銀": "银", "錄": "录", "錢": "钱", "録": "录", "錶": "表", "鏡": "镜", "鑰": "钥", "間": "间", "闆": "板",
    "電": "电", "頭": "头", "顏": "颜", "顔": "颜", "風": "风", "馬": "马", "髮": "发", "麪": "面", "麫": "面", "麵": "面", "麼": "么", "麽": "么",
    "黃": "黄", "齣": "出",
}
# fixed values: materials and sizes
MATERIALS = ["metal", "plastic", "glass", "fabric", "leather", "paper", "wood", "unknown"]
SIZES = ["small", "medium", "large"]
# fixed values: names in replies, (Korean, Chinese)
NAMES = {
    "type": {
        "bottle": ("물병", "水瓶"), "backpack": ("가방", "背包"), "laptop": ("노트북", "笔记本电脑"), "notebook": ("노트", "笔记本"), "book": ("책", "书"), "phone": ("휴대폰", "手机"),
        "charger": ("충전기", "充电器"), "cable": ("케이블", "数据线"), "mug": ("컵", "杯子"), "keys": ("열쇠", "钥匙"), "wallet": ("지갑", "钱包"), "umbrella": ("우산", "雨伞"),
        "headphones": ("이어폰", "耳机"), "glasses": ("안경", "眼镜"), "mouse": ("마우스", "鼠标"), "pen": ("펜", "笔"), "card": ("카드", "卡"), "tumbler": ("텀블러", "保温杯"),
        "power bank": ("보조배터리", "充电宝"), "tablet": ("태블릿", "平板"), "watch": ("시계", "手表"), "fan": ("선풍기", "风扇"), "tissue": ("휴지", "纸巾"), "hair tie": ("머리끈", "发圈"),
        "skateboard": ("스케이트보드", "滑板"), "case": ("케이스", "盒子"),
    },
    "color": {
        "black": ("검은색", "黑色"), "white": ("흰색", "白色"), "gray": ("회색", "灰色"), "silver": ("은색", "银色"), "red": ("빨간색", "红色"), "orange": ("주황색", "橙色"),
        "yellow": ("노란색", "黄色"), "green": ("초록색", "绿色"), "blue": ("파란색", "蓝色"), "purple": ("보라색", "紫色"), "pink": ("분홍색", "粉色"), "brown": ("갈색", "棕色"),
        "beige": ("베이지색", "米色"), "gold": ("금색", "金色"), "transparent": ("투명한", "透明"), "multicolor": ("여러 색", "多色"),
    },
    "material": {"metal": ("금속", "金属"), "plastic": ("플라스틱", "塑料"), "glass": ("유리", "玻璃"), "fabric": ("천", "布"), "leather": ("가죽", "皮革"), "paper": ("종이", "纸"), "wood": ("나무", "木头")},
    "size": {"small": ("작은", "小"), "medium": ("중간", "中"), "large": ("큰", "大")},
    "location": {
        "703": ("703호", "703房间"), "711": ("711호", "711房间"), "6f_meetingroom": ("6층 회의실", "6楼会议室"), "7f_tearoom": ("7층 탕비실", "7楼茶水间"),
        "8f_lobbytable": ("8층 로비 테이블 A", "8楼大堂桌A"), "8f_lobbytable_b": ("8층 로비 테이블 B", "8楼大堂桌B"), "hotelroom": ("호텔 방", "酒店房间"),
    },
    "relation": {
        "on": ("위에", "上面"), "beside": ("옆에", "旁边"), "near": ("근처에", "附近"), "inside": ("안에", "里面"), "overlapping": ("맞닿아", "紧挨着"), "same_surface": ("같은 곳에", "同一面上"),
        "left_of": ("왼쪽에", "左边"), "right_of": ("오른쪽에", "右边"), "above": ("위쪽에", "上方"), "below": ("아래쪽에", "下方"),
    },
}
RELATIONS_EN = {"on": "on top of", "overlapping": "touching", "same_surface": "on the same surface as", "left_of": "left of", "right_of": "right of"}
# fixed values: sentences of replies in English, Korean, Chinese
SENTENCES = {
    "found": ("Found it - the {what} is {where}.", "찾았습니다. {what}{i} {where} 있습니다.", "找到了。{what}在{where}。"),
    "found_unsure": ("I think I found it - the {what} is {where}. Please check the photo.", "아마 이것 같습니다. {what}{i} {where} 있습니다. 사진을 확인해 주세요.", "应该是这个。{what}在{where}。请核对照片。"),
    "picked": ("That one is {where}.", "그것은 {where} 있습니다.", "那个在{where}。"),
    "choose": ("I found {n} that I cannot tell apart. Which one is yours?", "{n}개를 찾았는데 설명만으로는 구분이 안 됩니다. 어느 것인가요?", "找到{n}个，光凭描述分不出来。是哪一个？"),
    "ask_color": ("I found {n} possible matches. What colour is yours? ({options})", "{n}개를 찾았습니다. 무슨 색인가요? ({options})", "找到{n}个。是什么颜色？({options})"),
    "ask_size": ("I found {n} possible matches. Roughly how big was it? ({options})", "{n}개를 찾았습니다. 크기가 어느 정도였나요? ({options})", "找到{n}个。大概多大？({options})"),
    "ask_material": ("I found {n} possible matches. What was it made of? ({options})", "{n}개를 찾았습니다. 재질이 무엇이었나요? ({options})", "找到{n}个。是什么材质？({options})"),
    "ask_location": ("I found {n} possible matches. Which place was it in? ({options})", "{n}개를 찾았습니다. 어디에 두셨나요? ({options})", "找到{n}个。放在哪里了？({options})"),
    "ask_near": ("I found {n} possible matches. Was it near anything you remember? ({options})", "{n}개를 찾았습니다. 무엇 옆에 있었는지 기억하시나요? ({options})", "找到{n}个。记得旁边有什么吗？({options})"),
    "not_found": ("I couldn't find a {what}. It may be outside the photographed area or hidden from view.", "{what}{eul} 찾지 못했습니다. 촬영 범위 밖이거나 가려져 있을 수 있습니다.", "没有找到{what}。可能不在拍摄范围内，或者被挡住了。"),
    "not_here": ("Then I don't have it. I checked every photo I have of {where}.", "그렇다면 제가 가진 사진에는 없습니다. {where}의 사진은 모두 확인했습니다.", "那我这里没有。{where}的照片我都看过了。"),
    "found_all": ("I found {n} {what}:", "{what} {n}개를 찾았습니다:", "找到{n}个{what}："),
    "give_up": ("I still see {n} possible matches. Here are the most likely ones:", "아직 {n}개가 남았습니다. 가장 가능성이 높은 것들입니다:", "还有{n}个。这些是最可能的："),
    "no_target": ("I'm not sure what you're looking for. Could you name the item?", "무엇을 찾으시는지 잘 모르겠습니다. 물건 이름을 말씀해 주시겠어요?", "我不确定您在找什么。可以说一下是什么物品吗？"),
}
JOINERS = (" or ", " 아니면 ", " 还是 ")
LANGUAGES = ("en", "ko", "zh")
# fixed values: sounds that speech recognition writes for the wake name, and other spellings
WAKE_SOUNDS = {
    "zh": (("嘿", "黑", "海", "嗨", "咳", "诶"), ("罗", "洛", "萝", "逻", "锣", "落", "啰"), ("帕", "怕", "趴", "啪", "爬", "巴", "吧", "拍", "扒")),
    "ko": (("헤이", "해이", "하이", "에이", "헤"), ("로", "노", "러", "라", "루"), ("파", "바", "빠", "퍼", "포", "화")),
}
WAKE_SPELLINGS = [
    "헤이로파야", "헤이롶아", "로파야", "로파", "로빠", "로퍼", "heylopa", "heylofa", "heyropa", "heyrofa", "heylopah", "heylopaa", "hailopa", "helopa",
    "heylowpa", "heyloppa", "heyloafa", "hailofa", "lopa", "lofa", "ropa", "hey로파", "헤이lopa", "헤이lofa",
]
GREETINGS_ZH = "嘿嗨诶喂"


def wake_names() -> list[str]:
    """All spellings of the name: every combination of its sounds, in Chinese also without the call before it."""
    heard = [a + b + c for sounds in WAKE_SOUNDS.values() for a in sounds[0] for b in sounds[1] for c in sounds[2]]
    return WAKE_SPELLINGS + heard + [b + c for b in WAKE_SOUNDS["zh"][1] for c in WAKE_SOUNDS["zh"][2]]
