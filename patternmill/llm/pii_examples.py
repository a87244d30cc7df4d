"""The small labelled table that the personal-data tagger learns from.

Each line is text in which [words](kind) marks a span; all names and values are invented.
The lines without marks are as important: they show which capitals, numbers, quotes and
signs are ordinary. expand() varies the values by rule, so the tagger learns shapes.
"""

from __future__ import annotations

import random
import re

LINES = """
Please contact Mr. [{first} {last}](person) at the office.
Mr. [{last}](person) signed the letter on Monday.
Mrs. [{first} {last}](person) has left the building.
Dr. [{last}](person) will see you now.
Yesterday Dr. [{first} {last}](person) spoke to the board.
The report was written by Ms. [{last}](person), who lives here.
Mr. [{first} {last}](person) came, and Mrs. [{first} {last}](person) went; all was well.
We met Ms. [{first} {last}](person) and Dr. [{last}](person) in town.
Mrs. [{first} {last}](person) said: token = "[{hex}](secret)" is old
name: [{first} {last}](person)
Name: [{first} {last}](person)
Herr [{last}](person) und Frau [{last}](person) kommen morgen.
Monsieur [{last}](person) est parti avec Madame [{first} {last}](person).
La señora [{last}](person) y el señor [{first} {last}](person) viven en la casa.
my name is [{first} {last}](person) and I agree
signed by Dr. [{first} {last}](person) in the presence of the clerk
token = "[{hex}](secret)"
token = "[{hex}](secret)" and the rest of the line
the file has token = "[{hex}](secret)" in it.
of the token = "[{hex}](secret)"### were*** not&&& told
api_key = "[{mixed}](secret)"
api_key: [{mixed}](secret)
secret = '[{mixed}](secret)'
password = "[{mixed}](secret)"
password: [{mixed}](secret)
export API_KEY=x then token: [{hex}](secret) end
access_token = "[{mixed}](secret)" # do not share
The token was old and the word is not a secret at all.
She asked for the password and the name of the house.
A key = value pair is read from the file.
the value of x = "plain" and of y = "other" is set
name the reasons, then sign by hand
He is. By. {word} ea of the {word} erer. La. {word} llies. El. {word} domi. The {word}.
{word} {word} {word} {word} {word} {word}
{word} {word} {word} {word} and the rest. {word} {word} the the the
ar. ar. {word} {word} {word} {word} {word} {word} {word} las las
Des. Des. {word} {word} on and of {word} {word} {word}
the words und.34@mail7.example.com of a.b@example.com are addresses
par.43@mail4.example.com ouen of.55@mail9.example.com hest thinbleing.27@mail6.example.com
Is. {word} by. {word} Of. {word} {word}. My. {word} that {word} is. {word} and {word}.
That is {word} by {word} of {word}, and la {word} el {word} und {word}.
Anblewh sttible athawh thonre was is anly hend and, oftionnten. Enti a wherer, anre.
THE ERTH OF ANINGES!! NDHA,!! ARE!! THE!! LYST IN,!! AND THAT!!
Eauouon. Enpaeux leaux le ouè eauenaux. Elle un la. Ouréaux qui éoireeau de.
Und der ie das des sich. Die heit und einungung, auf den ver. Für sch.
Las en, de que cióncies y boasrr. Ciónue. Del para no se. Por ososí.
Thlyouble | inesea | ononedth | worthless | onrein | Ndesat | thenti
La%%% queelle%%% elleeau### de*** viment$$$ éoion&&& les.
He met The Queen In Paris. They Went Home. Nobody Was There.
In 1999 there were 4111111111111111 reasons and 17 more, or 3.5 of them.
Call +1 (555) 555-0100 or write to a.b@example.com from 10.0.0.1 today.
Released under the MIT License. All rights reserved. Copyright 2020 The Authors.
This work is licensed under the GNU General Public License, version 3.
Item 5 of chapter 12, page 388: see also figures 3, 4 and 21.
"Is it here?" she said. "No," said he. (They left.)
""".strip().splitlines()

FIRST = "Ana Li Vera Anna Maria Juan Peter Claire Hans Lucía Omar Ingrid Paul Sofía Émile".split()
LAST = "Sol Ruiz Berg Miller Lopez Schmidt Dubois Okafor Tanaka García Weber O'Neil Novak Müller Lefèvre".split()

SYLLABLES = "an at de el en er es he ing ion la le men ou que re ri sch sto ten th ti ung ve".split()


def expand(copies: int = 8, seed: int = 3) -> list[tuple[list[str], list[str]]]:
    """(tokens, kinds) rows; a kind is O, or B-kind at a span's first token and I-kind inside."""
    rng = random.Random(seed)
    rows = []
    for line in LINES:
        for _ in range(copies):
            text = line
            for name, make in (
                ("{first}", lambda: rng.choice(FIRST)),
                ("{last}", lambda: rng.choice(LAST)),
                ("{word}", lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))).capitalize()),
                ("{hex}", lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(20, 40)))),
                ("{mixed}", lambda: "".join(rng.choices("ABCDEFGHKLMNPQRSTabcdefghkmnpqrst23456789", k=rng.randint(12, 32)))),
            ):
                while name in text:
                    text = text.replace(name, make(), 1)
            tokens, kinds = [], []
            for part in re.split(r"(\S*\[[^\]]*\]\(\w+\)\S*)", text):
                if m := re.fullmatch(r"(\S*)\[([^\]]*)\]\((\w+)\)(\S*)", part):
                    own = f"{m[1]}{m[2]}{m[4]}".split()
                    tokens += own
                    kinds += [f"{'I' if i else 'B'}-{m[3]}" for i in range(len(own))]
                else:
                    tokens += part.split()
                    kinds += ["O"] * len(part.split())
            rows.append((tokens, kinds))
            if "{" not in line:
                break
    return rows
