"""Fixed values of the verdicts on announcements: words and places, in the order in which they are tried."""

from __future__ import annotations

WANTED = [
    "IT", "ICT", "SW", "소프트웨어", "정보기술", "정보통신", "디지털", "플랫폼", "클라우드", "SaaS", "AI", "인공지능", "머신러닝", "딥러닝", "데이터", "빅데이터", "자연어처리", "LLM", "생성형",
    "AX", "DX", "IoT", "사물인터넷", "XR", "메타버스", "블록체인", "핀테크", "5G", "6G", "반도체", "로봇", "정보보호", "정보보안", "사이버보안", "융합보안", "보안", "창업", "스타트업", "벤처",
    "예비창업", "초기창업", "성장", "스케일업", "액셀러레이터", "보육", "R&D", "연구개발", "기술개발", "사업화", "바우처", "지원금", "보조금", "투자",
]
WHOLE = [
    "IT", "SW",
]
STRONG = [
    "AI", "AX", "DX", "SW", "ICT", "IoT", "SaaS", "인공지능", "소프트웨어", "데이터", "디지털", "클라우드", "정보보호", "보안", "플랫폼",
]
UNWANTED = [
    "농업", "축산", "수산", "임업", "광업", "제조업", "금형", "주조", "용접", "섬유", "의류", "건설", "토목", "조선업", "조선해양", "철강", "석유화학", "신재생에너지", "태양광", "풍력", "원자력", "의료기기",
    "제약사", "제약산업", "관광", "숙박", "외식", "요식업", "운송",
]
MILDLY_UNWANTED = [
    "제조", "에너지", "바이오", "물류",
]
KEYWORD_PATTERNS = {
    "제조": r"(?<!경)제조",
    "관광": r"(?<!체육)관광",
}
OVER = [
    r"(선정|평가|심사|최종|서류|발표)\s*결과",
    r"결과\s*(공고|안내|발표|알림)",
    r"입법\s*예고",
    r"행정\s*예고",
    r"하위\s*법령",
    r"합격자\s*(발표|공고)",
    r"대상자\s*선정\s*(공고|안내|결과)",
    r"[\[(【〔<]\s*(?:접수|모집|신청|공고|조기)?\s*마감(?:됨|완료)?\s*[\])】〕>]",
    r"(?<!시 )(?<!시)조기\s*마감(?!\s*(?:될|되|시|가능|예정|할|주의|우려|있))",
]
NEAR = [
    "서울", "경기", "수도권", "성남", "판교", "분당", "수원", "용인", "고양", "과천", "안산", "화성",
]
FAR = [
    "부산", "대구", "인천", "광주광역시", "대전", "울산", "세종", "강원", "충북", "충청북도", "충남", "충청남도", "전북", "전라북도", "전남", "전라남도", "전남광주", "경북", "경상북도", "경남", "경상남도",
    "제주", "대덕특구", "대덕연구개발특구", "구미", "포항", "창원", "진주", "김해", "거제", "천안", "아산", "청주", "충주", "전주", "군산", "익산", "목포", "여수", "순천", "안동", "경주", "춘천", "원주",
    "강릉", "홍성", "호남권", "영남권", "충청권", "대경권", "강원권", "제주권", "경상권", "전라권", "부울경", "비수도권",
]
REGION_PATTERNS = {
    "수도권": r"(?<!비)수도권",
    "부산": r"부산(?!물)",
    "대전": r"(?<![가-힣])대전(?!환)",
    "세종": r"세종(?=특별자치시|시|창조경제|테크노파크|TP)",
    "아산": r"아산(?!나눔|병원|재단|의료원|사회복지|정책)",
    "전주": r"(?<![가-힣])전주(?!기)",
    "여수": r"여수(?!신)",
    "경주": r"(?<![가-힣])경주(?!마|대회|용)",
    "원주": r"원주(?!민)",
}
UNSURE = [
    r"(?<![가-힣])광주(?!광역시)",
    "동남권",
    "동북권",
]
FAR_AS_TAG = [
    "세종", "광주",
]
TENDERS = r"입찰|조달|사전\s*규격|사전\s*공개"
