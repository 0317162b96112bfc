"""Phrases that label lines of training pages; fixed values, in the languages of the pages. Used by ``train_blocks`` only."""

from __future__ import annotations

import re

from corvane.llm.blocks import DECORATION, INVISIBLE, SPACE, plain

#: Entries of site menus.
MENU = {
    *"about us|blog|book now|careers|contact|faq|gallery|home|locations|log in|prices|reviews|services|shop".split("|"),
    *"accueil|contact|emplois|questions|qui sommes-nous|réserver|se connecter|services|tarifs".split("|"),
    *"contacto|empleo|entrar|inicio|nosotros|precios|preguntas|reservar|servicios".split("|"),
    *"anmelden|fragen|karriere|kontakt|leistungen|preise|standorte|startseite|termin buchen|über uns".split("|"),
    *"お問い合わせ|よくある質問|サービス|ホーム|予約|会社案内|料金|採用情報|ブログ|採用|ログイン".split("|"),
}

#: Openings and phrases of lines that are no main content.
PHRASES = [
    r"^(you are here|vous êtes ici|está aquí|estás aquí|sie sind hier|現在地)\s?[:：]",
    r"(uses?|our use of|utilise des|usage de|usa|uso de|verwenden|nutzung von) cookies|^cookie settings|クッキーを使用", r"^(we value your privacy|this site remembers your choices)", r"store small files on your device",
    r"^ask about the .* discount", r"^trade fair in", r"office is closed this week", r"^we are hiring in", r"^road works near",
    r"^(by|par|von|por|redacción|redaktion|rédaction|la rédaction)\s(?:[^.!?]|\b\w{1,2}\.)*$", r"^(written by|posted by|reviewed by|escrito por|geprüft von|relu par|revisado por)\s.{3,90}$",
    r"^文[:：]", r"^by the .* editorial team", r"編集部",
    r"^(last updated|updated|reading time|mis à jour|stand:|actualizado|最終更新|読了時間|lesezeit|tiempo de lectura|temps de lecture)",
    r"^\d+ (comments?|commentaires?|comentarios?|kommentare?)$", r"^コメント", r"^(page|seite|página) \d+ (of|sur|von|de) \d+",
    r"^(share this|print this page|did you like this page|was this helpful|partager|diese seite teilen|compartir|このページを共有|cet article vous a|¿le ha sido útil|war dieser beitrag|この記事は役に立ち)",
    r"^(sign up for|get our tips|join [\d,.]+ readers|download the .* app|recevez la lettre|reciba el boletín|jetzt den rundbrief)|お知らせを受け取る",
    r"^(related articles|you may also like|more from|most read|read more:|también le puede interesar|más de |関連記事|mehr von|les plus lus|lea también|à lire aussi|das könnte sie auch)",
    r"^(next article|next|previous|previous article|article suivant|article précédent|siguiente|anterior|weiter|zurück|次の記事|前の記事)\s?[:：]",
    r"^(tags|mots-clés|etiquetas|schlagwörter|schlagworte|タグ)\s?[:：]",
    r"^©", r"all rights reserved|tous droits réservés|todos los derechos|alle rechte vorb|無断転載", r"^(imprint|mentions légales|aviso legal|impressum|サイトマップ)\b",
    r"is a registered trading name", r"^reproduction, even in part", r"^trade marks belong", r"^errors and omissions", r"^the information on this page is general",
    r"^all prices include tax", r"^prix toutes taxes", r"^informations données sans", r"^información sin garantía", r"^alle angaben ohne", r"^alle preise inkl",
    r"^precios con impuestos", r"^掲載内容は", r"^opening hours:", r"^(designed and hosted by|back to top|haut de page|volver arriba|nach oben|ページの先頭へ)",
    r"^for three generations|^new at .*pay in parts|^depuis trois générations|^desde hace tres gen|^seit drei gen|三代にわたり",
]
PHRASE = re.compile("|".join(f"(?:{p})" for p in PHRASES))
#: Headings of lists of other pages.
RELATED = re.compile(r"^(related articles|you may also like|more from|most read|también le puede interesar|más de |関連記事|mehr von|les plus lus|lea también|à lire aussi|das könnte sie auch)")
#: Entries that such a list has at most.
LIST = 4
CONTACT = re.compile(r"^[\w& ]{3,40}?(?:co|yard|guild|works|house|studio|service) ?(?:[|,-]|–).*(?:@|\(at\)|\[at\]|\d{3})|^(?:p\.? ?o\.? )?box \d+, .*\d{3}")
_SPLIT = re.compile(r"\s*[|·•»>/]\s*|\s{2,}|\]\s*\[|[\[\]]")
_MENU_LONGEST_FIRST = sorted(MENU, key=len, reverse=True)


def is_menu(line: str) -> bool:
    s = DECORATION.sub("", INVISIBLE.sub("", line).strip().lower())
    parts = [SPACE.sub(" ", p).strip() for p in _SPLIT.split(s)]
    parts = [p for p in parts if p]
    if parts and all(p in MENU for p in parts):
        return True
    rest = SPACE.sub(" ", re.sub(r"[|·•»>/\[\]]", " ", s))
    if not parts or len(rest) > 120:
        return False
    for m in _MENU_LONGEST_FIRST:
        rest = rest.replace(m, "")
    return not rest.strip()


def is_boilerplate(line: str) -> bool:
    n = plain(line)
    return bool(n) and (is_menu(line) or (len(n) < 260 and bool(PHRASE.search(n) or CONTACT.search(n))))


def label_lines(lines: list[str]) -> list[int]:
    """-1 blank, 0 main content, 1 no content, 2 entry of a list of other pages."""
    out = [-1 if not plain(x) else int(is_boilerplate(x)) for x in lines]
    at = [i for i, x in enumerate(out) if x >= 0]
    for a, i in enumerate(at):
        if not RELATED.search(plain(lines[i])):
            continue
        run = []
        for k in at[a + 1 :]:
            n = plain(lines[k])
            if out[k] == 1 or len(n) >= 110 or n[-1] in ".!?。" or re.search(r"\d\d:\d\d|^[^ ]+ [·/|] ", n):
                break
            run.append(k)
        for k in run[:LIST]:
            out[k] = 2
    return out
