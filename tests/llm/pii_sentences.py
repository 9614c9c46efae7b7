"""Hand-written sentences, none from the generator: irregular spellings of personal data, and numbers that are none."""

#: kind -> (sentence, the span's text); none of these is found by the patterns
SPANS = {
    "email": [
        ("You can reach Ines at ines.mora (at) lumen-press.org any day.", "ines.mora (at) lumen-press.org"),
        ("Send the draft to k.oduya[at]harbourlab.net before noon", "k.oduya[at]harbourlab.net"),
        ("contact: petra_w(at)seefeld.de or call the desk", "petra_w(at)seefeld.de"),
        ("write to tomas @ quarry.io for the keys", "tomas @ quarry.io"),
        ("Questions? anna.k (at) northwind (dot) com answers them.", "anna.k (at) northwind (dot) com"),
        ("my old address was juliet[at]brightfold[dot]org, now closed", "juliet[at]brightfold[dot]org"),
        ("please mail raul.v (at) campo-verde.fr about the lease", "raul.v (at) campo-verde.fr"),
        ("The author (mina77 [at] papertrail.net) replied late.", "mina77 [at] papertrail.net"),
        ("bugs go to dev.team(at)orchard.io and nowhere else", "dev.team(at)orchard.io"),
        ("editor@ linden.com is the desk", "editor@ linden.com"),
        ("Booking via reception (at) seaview [dot] com is free", "reception (at) seaview [dot] com"),
        ("forward it to h.lindqvist [at] fjordmail.org today", "h.lindqvist [at] fjordmail.org"),
    ],
    "ip": [
        ("The request came from 192[.]168[.]44[.]7 at night.", "192[.]168[.]44[.]7"),
        ("blocked host 10[.]0[.]12[.]250 for a week", "10[.]0[.]12[.]250"),
        ("traffic to 203(.)0(.)113(.)9 was dropped", "203(.)0(.)113(.)9"),
        ("ping 172 . 16 . 8 . 91 shows no loss", "172 . 16 . 8 . 91"),
        ("server at 198[.]51[.]100[.]23 went down", "198[.]51[.]100[.]23"),
        ("we saw 45[.]77[.]120[.]3, then nothing", "45[.]77[.]120[.]3"),
        ("login from 88[dot]12[dot]200[dot]41 failed", "88[dot]12[dot]200[dot]41"),
        ("gateway=10[.]1[.]1[.]254 in the config", "10[.]1[.]1[.]254"),
        ("the camera sits on 192 . 168 . 0 . 64 downstairs", "192 . 168 . 0 . 64"),
        ("Address: 151(.)101(.)1(.)69.", "151(.)101(.)1(.)69"),
    ],
    "card": [
        ("She paid with 4539.1488.0343.6467 on Friday.", "4539.1488.0343.6467"),
        ("card no 5500/0000/0000/0004 expires soon", "5500/0000/0000/0004"),
        ("charge 4716_1080_9997_1531 for the room", "4716_1080_9997_1531"),
        ("Visa 4024.0071.0902.2144 was declined", "4024.0071.0902.2144"),
        ("old card: 5425.2334.3010.9903, please delete it", "5425.2334.3010.9903"),
        ("the number 6011/1111/1111/1117 is a test", "6011/1111/1111/1117"),
        ("use 4111 - 1111 - 1111 - 1111 at the till", "4111 - 1111 - 1111 - 1111"),
        ("bill 5105_1051_0510_5100 every month", "5105_1051_0510_5100"),
        ("He read out 4012  8888  8888  1881 twice.", "4012  8888  8888  1881"),
        ("refund goes to 4222.2222.2222.2220 by May", "4222.2222.2222.2220"),
    ],
    "phone": [
        ("Call (212) 555-0147 after six.", "(212) 555-0147"),
        ("phone 743-555-3824 for the shop", "743-555-3824"),
        ("Her number is 415.555.0199, ask for Lea.", "415.555.0199"),
        ("text 1-800-555-0133 to stop", "1-800-555-0133"),
        ("Office: 0044 20 7946 0958 in the morning", "0044 20 7946 0958"),
        ("Tel. 0033 1 42 68 53 00 on weekdays", "0033 1 42 68 53 00"),
        ("ring (646)555.0123 and wait", "(646)555.0123"),
        ("the plumber, 503-555-0172, came at once", "503-555-0172"),
        ("Fax (312) 555-0188 no longer works", "(312) 555-0188"),
        ("or dial 001 617 555 0110 from abroad", "001 617 555 0110"),
        ("mobile: 702.555.0145.", "702.555.0145"),
        ("contact 919-555-0121 with any news", "919-555-0121"),
    ],
}

#: sentences in which nothing is personal data
CLEAN = [
    "The meeting on 2023-11-04 at 09:30:00 was moved to 2023-11-18.", "Version 3.12.4 fixes 27 bugs and adds 14 features.", "In 1998 about 12,400 people lived there, in 2021 some 15,300.",
    "The commit 9fceb02d0ae598e95dc970b74767f19372d61af8 broke the build.", "Chapter 12, pages 340-365, tells the rest.", "It cost $1,299.00, or 1.299,00 euros.", "Order AB-90412 left on 03/09/2022 and came on 07/09/2022.",
    "ISBN 978-0-14-044913-6 is out of print.", "Scores were 21:17, 18:21 and 21:19.", "The ratio fell from 0.482 to 0.0371 in 16 steps.", "See section 4.2.1 and table 7.", "Room 1408, floor 14, open 8-17.",
    "A box of 24 x 36 x 18 cm weighs 7.5 kg.", "The years 1914 1918 1939 1945 were on the stone.", "He ran 10 km in 00:41:27 and 42 km in 03:21:08.", "Meet @lena and @tomas at the gate.", "Pi is 3.14159265358979 and e is 2.718281828459.",
    "The train 4711 leaves at 18:05 from track 9.", "uuid 123e4567-e89b-12d3-a456-426614174000 is the key.", "About 7 000 000 000 000 cells die a day.", "mass 5.972 x 10 24 kg, radius 6371 km", "lat 52.5200, lon 13.4050", "Color #33aa77 on #ffffff", "GET /img/2019/07/0041.png 200 5316",
    "population: 83 237 124 (2021)", "the 3-2-1 rule and the 80/20 rule", "tickets 10 @ 4.50 each", "Temperature: -12.5 to 31.8 degrees", "id 00000000000000000000000000000042", "Grades 1 2 3 4 5 6 in one class of 31",
]
