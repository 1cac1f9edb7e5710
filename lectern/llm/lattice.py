"""Word lattices for scripts that write no spaces between words.

A run of characters is cut into words by its cheapest path: a dictionary word costs a little, a stretch of characters outside
any word costs more and grows with its length, so that unknown words stay whole. The dictionaries are lists of frequent words by their
part in a sentence; to those of Chinese and Japanese the words of a public tokenizer's vocabulary are added, whose file must be there.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

from lectern.llm.encoding import BYTE_BPE_50K, read_ranks

# Thai: verbs and adjectives that make a clause, final particles, words that carry a sentence on, and others.
THAI_PREDICATES = frozenset(
    """ถูก ต้อง เป็น คือ มี ได้ ให้ เปิด ปิด หยุด ใช้ ใช้งาน รอ ว่าง เก็บ สร้าง ทำ ทำงาน ลอง เริ่ม อ่าน เขียน ส่ง รับ ตรวจ ตรวจสอบ
    ลบ เพิ่ม ลด เปลี่ยน แก้ แก้ไข รีสตาร์ต อัปเกรด ติดตั้ง บันทึกไว้ พบ เห็น รู้ คิด บอก ถาม ตอบ ไป มา อยู่ กลับ เข้า ออก ขึ้น ลง
    ดู ฟัง พูด เรียก ขอ เกิด หาย จบ เสร็จ ล้มเหลว สำเร็จ แสดง ปฏิเสธ ยอมรับ ย้าย ควร สามารถ อาจ จะ กำลัง เคย ไม่ ห้าม อย่า เต็ม ดี
    ชอบ รัก เกลียด กิน ดื่ม นอน หลับ ตื่น วิ่ง เดิน นั่ง ยืน ซื้อ ขาย เล่น เรียน สอน ช่วย หา เจอ ร้อง เห่า ร้องเพลง หัวเราะ ร้องไห้ ยิ้ม
    ล้าง ซัก ทอด ต้ม ขับ บิน ว่ายน้ำ ปลูก ตัด วาด ถ่าย โทร เชื่อ เข้าใจ จำได้ ลืม หวัง กลัว โกรธ เสียใจ ดีใจ เหนื่อย หิว อิ่ม ป่วย ตาย
    แต่งงาน พัก พักผ่อน เที่ยว เดินทาง มาถึง ถึง รู้จัก สนใจ ตัดสินใจ ยืม คืน จ่าย แพง สวย งาม ใหญ่ เล็ก ร้อน หนาว เร็ว ช้า ดัง เงียบ
    สว่าง มืด สูง เตี้ย ยาว สั้น หนัก เบา อร่อย เผ็ด หวาน เค็ม เปรี้ยว สะอาด สกปรก ง่าย ยาก สนุก พร้อม ผิด ตก ไหล พัง เสีย ชำรุด ซ่อม
    รีบ หนี ไล่ จับ โยน ผลัก ดึง ยก วาง ใส่ ถอด สวม อาบน้ำ โหลด ดาวน์โหลด อัปโหลด ค้นหา เชื่อมต่อ ตั้งค่า กด คลิก พิมพ์ ยกเลิก
    ยืนยัน อนุญาต แจ้ง แจ้งเตือน รายงาน ประกาศ เผยแพร่ คัดลอก สำรอง กู้คืน ต้องการ อยาก พยายาม เลือก เปรียบเทียบ อธิบาย แนะนำ จัดการ
    ควบคุม ป้องกัน รักษา สนับสนุน พัฒนา ผลิต ประชุม วางแผน ชนะ แพ้ เสนอ สั่ง สั่งซื้อ นำ พา ฝาก เฝ้า ดูแล ใช้เวลา หมดอายุ ทดสอบ""".split()
)
THAI_FINAL = frozenset("แล้ว หรือยัง เสมอ ไหม มั้ย ครับ ค่ะ คะ นะ ได้ ด้วย เลย ยัง หรือ หรือไม่ อยู่ จ้ะ สิ เถอะ จัง หรอก ล่ะ จ้า".split())
THAI_OPENING = frozenset("และ แต่ หรือ เพราะ เนื่องจาก ซึ่ง ที่ จึง โดย เพื่อ ถ้า หาก เมื่อ ก่อน หลัง จาก กับ ของ ว่า รวมถึง ตลอดจน อันเนื่อง".split())
THAI_OTHER = frozenset(
    """ไฟล์ เวอร์ชัน เก่า ใหม่ ดัชนี แคช คิว ผู้ ระบบ บริการ โหนด ดิสก์ วัน วินาที นาที ชั่วโมง นาน ไว้ เกตเวย์ บันทึก การ ความ
    ผู้ดูแลระบบ คน บ้าน เมือง งาน วันนี้ พรุ่งนี้ เมื่อวาน นี้ นั้น เขา เธอ ฉัน ผม เรา พวกเขา มาก น้อย ทุก แต่ละ ใน บน ใต้ ข้อมูล ผู้ใช้
    แมว หมา สุนัข นก ปลา ช้าง ม้า วัว หมู ไก่ พ่อ แม่ พี่ น้อง ลูก ลุง ป้า ยาย เพื่อน ครู นักเรียน หมอ เด็ก ผู้ชาย ผู้หญิง ข้าว น้ำ อาหาร
    ผลไม้ รถ รถไฟ เครื่องบิน ถนน โรงเรียน โรงพยาบาล ตลาด ร้าน ห้อง ประตู หน้าต่าง โต๊ะ เก้าอี้ เตียง หนังสือ ปากกา โทรศัพท์ คอมพิวเตอร์
    เสียง เพลง ภาพ หนัง ฝน ฟ้า แดด ลม ทะเล ภูเขา แม่น้ำ ป่า ต้นไม้ ดอกไม้ เช้า กลางคืน กลางวัน ปี เดือน สัปดาห์ เวลา เงิน ราคา ชื่อ
    ประเทศ ภาษา ไทย อังกฤษ โปรแกรม เครื่อง หน้าจอ เอกสาร รายการ ตาราง รหัส ผ่าน บัญชี ลูกค้า พนักงาน บริษัท โครงการ ปัญหา คำถาม คำตอบ""".split()
)

# Chinese and Japanese: words that carry a sentence on behind a quotation or a mark of omission, and final particles.
CHINESE_CARRY_ON = frozenset("然后 然後 随后 隨後 接着 便 就 而后 并 並 但 但是 的 地 又 还 還 也 才 都".split())
JAPANESE_CARRY_ON = frozenset("と って という が を は も に の など".split())
CHINESE_FINAL = frozenset("了 吗 嗎 吧 呢 啊 嘛 呀 啦".split())
JAPANESE_FINAL = frozenset("です ます ました ません ください でした だった ですか ますか よ ね か".split())
CHINESE_WORDS = frozenset(
    """就是 就业 就業 就任 就近 就算 并非 並非 并发 並發 并行 並行 并购 但愿 但願 便宜 便利 便于 便於 地方 地址 地图 地圖 地区 地區 地点 的确 的確 都市 才能 又名
    我们 我們 你们 他们 这个 這個 那个 可以 没有 沒有 因为 因為 如果 时候 時候 什么 什麼 今天 明天 昨天 现在 現在 系统 服务 文件 数据 问题 版本 请求 时间""".split()
)
JAPANESE_WORDS = frozenset("とても とき ところ ともに とにかく はい はじめ もし もう もっと もの にほん のち がんばる をはじめ こと これ それ あれ この その ここ そこ です ます ました ません ください でした した して ない".split())

THAI = "ก-ฺเ-๎"
HAN, KANA = "㐀-鿿豈-﫿", "぀-ヿ"
WHOLE_WORD = re.compile(rf"[{HAN}]{{2,}}|[{HAN}{KANA}]*[{KANA}][{HAN}{KANA}]+")
#: Cost of a dictionary word, of opening a stretch outside all words, and of each of its characters.
WORD, UNKNOWN, CHARACTER = 1.0, 1.5, 0.75
# Thai vowels and marks that never begin a word.
NEVER_FIRST = frozenset("ะัาำิีึืฺุู็่้๊๋์ํ๎ๅ")


@lru_cache(maxsize=4)
def vocabulary(path: str | None = None) -> frozenset[str]:
    """Whole words of Chinese and Japanese in the ranks of a public tokenizer.

    A file that can't be read, is no rank file or has no such word is an error, since without its words other sentences are found.
    """
    path = path or os.path.join(os.path.dirname(BYTE_BPE_50K), "byte_bpe_multi_50k.tiktoken")
    words = set()
    for token in read_ranks(path):
        try:
            word = token.decode("utf-8").strip()
        except UnicodeDecodeError:  # a token that begins or ends within a character is no word
            continue
        if WHOLE_WORD.fullmatch(word):
            words.add(word)
    if not words:
        raise ValueError(f"no words of Chinese or Japanese in {path}")
    return frozenset(words)


@lru_cache(maxsize=1)
def thai_words() -> frozenset[str]:
    """The Thai dictionary."""
    return THAI_PREDICATES | THAI_FINAL | THAI_OPENING | THAI_OTHER


@lru_cache(maxsize=1)
def thick_words() -> frozenset[str]:
    """The dictionary of Chinese and Japanese."""
    return CHINESE_CARRY_ON | JAPANESE_CARRY_ON | CHINESE_FINAL | JAPANESE_FINAL | CHINESE_WORDS | JAPANESE_WORDS | vocabulary()


def cheapest_words(run: str, words: frozenset[str]) -> list[str]:
    """The words of the cheapest path through the lattice of a run; a stretch outside the dictionary is one word.

    Every character has two nodes: the end of a dictionary word, and the end so far of a stretch outside it.
    """
    longest = max(map(len, words), default=1)
    n, far = len(run), float("inf")
    known, unknown = [0.0] + [far] * n, [far] * (n + 1)
    from_known = [0] * (n + 1)  # where the dictionary word that ends here began
    opened = [False] * (n + 1)  # whether the stretch that ends here was opened by its last character
    for i in range(n):
        free = run[i] not in NEVER_FIRST
        start = min(known[i], unknown[i])
        if free or i == 0:
            for j in range(i + 1, min(n, i + longest) + 1):
                if start + WORD < known[j] and run[i:j] in words and (j == n or run[j] not in NEVER_FIRST):
                    known[j], from_known[j] = start + WORD, i
        if i and "぀" <= run[i - 1] <= "ゟ" and run[i] > "ㄯ":  # a stretch of Japanese ends where a new ideograph begins
            fresh, grown = start + UNKNOWN + CHARACTER, far
        else:
            fresh, grown = known[i] + UNKNOWN + CHARACTER, unknown[i] + CHARACTER
        if not free and i:
            fresh += 4.0
        unknown[i + 1], opened[i + 1] = (fresh, True) if fresh < grown else (grown, False)
    cuts, j, inside, end = [], n, unknown[n] < known[n], n
    while j:
        if inside:
            if opened[j]:
                cuts.append((j - 1, end))
                end = j - 1
                inside = j > 1 and unknown[j - 1] < known[j - 1]
            j -= 1
        else:
            i = from_known[j]
            cuts.append((i, j))
            j, end = i, i
            inside = j > 0 and unknown[j] < known[j]
    return [run[i:j] for i, j in reversed(cuts)]
