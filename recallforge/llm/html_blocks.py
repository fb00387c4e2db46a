"""A small labelled table of text blocks for the HTML classifier, labelled by hand from typical page layouts.

Columns: words and link density of the block before, of the block and of the block after; whether the block lies in a
menu, header, footer, sidebar, notice, advert, form or comment container, within its article container if it has one;
whether its article container lies in something that is named like one of these; whether it has an article container;
and whether it is main text.
"""

# prev_words prev_links words links next_words next_links chrome outer article main
LABELLED = """
0 0.00 1 1.00 1 1.00 1 0 0 0
1 1.00 1 1.00 1 1.00 1 0 0 0
1 1.00 2 1.00 3 1.00 1 0 0 0
2 1.00 1 1.00 8 0.00 1 0 0 0
1 1.00 9 0.00 12 0.00 1 0 0 0
6 1.00 14 0.00 10 0.00 1 0 0 0
0 0.00 4 0.00 2 1.00 1 0 0 0
0 0.00 25 0.10 2 1.00 1 0 0 0
40 0.00 12 0.00 0 0.00 1 0 0 0
65 0.02 7 0.30 5 0.60 1 0 0 0
120 0.00 30 0.05 0 0.00 1 0 0 0
18 0.00 22 0.00 20 0.00 1 0 0 0
30 0.00 45 0.00 38 0.00 1 0 0 0
12 0.00 60 0.00 25 0.00 1 0 0 0
50 0.00 6 0.00 40 0.00 1 0 1 0
80 0.00 20 0.00 60 0.00 1 0 1 0
9 0.00 3 1.00 70 0.00 1 0 1 0
33 0.10 15 0.00 44 0.00 1 0 1 0
90 0.00 1 0.00 1 0.00 1 0 1 0
5 1.00 35 0.00 90 0.00 1 0 1 0
200 0.00 70 0.00 100 0.00 1 0 1 0
16 0.00 3 0.00 12 0.00 1 0 1 0
12 0.00 5 0.00 0 0.00 1 0 1 0
34 0.00 10 0.00 0 0.00 1 0 0 0
30 0.00 15 0.00 0 0.00 1 0 0 0
70 0.00 45 0.00 60 0.00 1 0 0 0
7 0.00 11 0.00 60 0.00 0 0 1 1
9 0.00 90 0.00 75 0.00 0 0 1 1
60 0.00 1 0.00 44 0.00 0 0 1 1
80 0.00 2 0.00 9 0.00 0 0 1 1
14 0.00 45 0.22 66 0.00 0 0 1 1
40 0.00 18 0.40 22 0.00 0 0 1 1
10 0.00 64 0.00 10 0.00 0 0 1 1
25 0.00 7 0.00 0 0.00 0 0 1 1
90 0.00 4 1.00 5 1.00 0 0 1 0
4 1.00 6 1.00 5 1.00 0 0 1 0
70 0.00 9 0.95 2 1.00 0 0 1 0
20 0.00 2 1.00 60 0.00 0 0 1 0
12 0.00 3 0.90 4 1.00 0 0 1 0
3 1.00 2 1.00 1 1.00 0 0 0 0
2 1.00 12 0.80 3 1.00 0 0 0 0
3 1.00 14 0.10 2 1.00 0 0 0 0
1 1.00 10 0.40 1 1.00 0 0 0 0
30 0.90 25 0.85 40 0.95 0 0 0 0
15 1.00 40 0.70 22 1.00 0 0 0 0
60 0.00 6 0.00 55 0.00 0 0 0 1
45 0.00 3 0.00 80 0.00 0 0 0 1
90 0.05 12 0.00 30 0.00 0 0 0 1
2 1.00 38 0.00 60 0.00 0 0 0 1
38 0.00 75 0.03 50 0.00 0 0 0 1
50 0.00 110 0.00 4 1.00 0 0 0 1
7 0.00 55 0.10 41 0.02 0 0 0 1
41 0.02 28 0.15 66 0.00 0 0 0 1
20 0.00 21 0.00 33 0.05 0 0 0 1
5 1.00 140 0.00 6 1.00 0 0 0 1
9 0.00 48 0.20 8 0.00 0 0 0 1
4 0.00 33 0.00 3 0.00 0 0 0 1
80 0.00 19 0.10 45 0.00 0 0 0 1
35 0.10 24 0.00 2 0.00 0 0 0 1
100 0.00 9 0.00 70 0.00 0 0 0 1
16 0.00 2 0.00 60 0.05 0 0 1 1
7 0.00 7 0.00 18 0.05 0 0 1 1
33 0.00 1 0.00 14 0.15 0 0 1 1
2 1.00 3 0.00 8 0.50 0 0 1 1
3 1.00 60 0.00 20 0.60 0 0 1 1
120 0.00 11 0.00 9 0.40 0 0 1 1
45 0.00 26 0.00 6 1.00 0 0 1 1
70 0.00 5 0.00 16 0.30 0 0 1 1
1 0.00 2 0.00 3 0.35 0 0 1 1
1 1.00 2 0.00 2 0.00 0 0 1 1
8 0.30 9 0.00 9 0.00 0 0 1 1
10 0.00 10 0.10 0 0.00 0 0 1 1
0 0.00 2 0.00 0 0.00 0 0 1 1
0 0.00 80 0.00 0 0.00 0 0 1 1
3 0.00 6 0.00 6 0.00 0 0 1 1
6 0.00 3 0.00 300 0.00 0 0 1 1
300 0.00 4 0.00 1 0.00 0 0 1 1
40 0.60 14 0.00 12 0.70 0 0 1 1
25 1.00 22 0.05 30 1.00 0 0 1 1
15 0.00 1 0.00 2 0.50 0 0 1 1
28 0.00 3 0.00 4 0.80 0 0 1 1
14 0.00 8 0.45 30 0.00 0 0 1 1
60 0.00 40 0.40 3 0.00 0 0 1 1
11 0.00 24 0.00 5 0.00 0 0 1 1
2 0.00 15 0.00 7 0.00 0 0 1 1
8 0.00 2 0.70 12 0.00 0 0 1 0
31 0.00 5 0.65 9 0.00 0 0 1 0
0 0.00 1 1.00 50 0.00 0 0 1 0
66 0.00 14 0.80 0 0.00 0 0 1 0
9 0.00 25 0.75 40 0.00 0 0 1 0
12 0.00 10 0.00 12 0.00 0 0 0 0
14 0.00 11 0.00 2 1.00 0 0 0 0
0 0.00 12 0.00 0 0.00 0 0 0 0
16 0.05 5 0.00 16 0.10 0 0 0 0
9 0.00 13 0.20 9 0.30 0 0 0 0
3 0.00 60 0.80 4 0.00 0 0 0 0
0 0.00 40 0.00 0 0.00 0 0 0 1
8 0.00 200 0.00 8 0.00 0 0 0 1
12 0.00 26 0.00 14 0.00 0 0 0 1
1 1.00 7 0.00 55 0.00 0 0 0 1
7 0.00 55 0.00 80 0.05 0 0 0 1
55 0.00 80 0.05 3 0.00 0 0 0 1
80 0.05 3 0.00 60 0.00 0 0 0 1
3 0.00 60 0.00 9 0.00 0 0 0 1
60 0.00 9 0.00 40 0.00 0 0 0 1
9 0.00 40 0.00 4 1.00 0 0 0 1
9 1.00 16 0.10 2 1.00 0 0 0 0
8 1.00 21 0.00 2 1.00 0 0 0 0
5 0.40 4 0.75 10 0.00 0 0 0 0
4 0.75 10 0.00 120 0.02 0 0 0 1
10 0.00 120 0.02 12 0.00 0 0 0 1
120 0.02 12 0.00 95 0.10 0 0 0 1
12 0.00 95 0.10 33 0.00 0 0 0 1
95 0.10 33 0.00 5 0.80 0 0 0 1
3 0.00 1 0.00 4 0.00 0 0 0 0
4 0.00 24 0.00 1 1.00 0 0 0 0
24 0.00 1 1.00 24 0.00 0 0 0 0
1 1.00 24 0.00 1 1.00 0 0 0 0
0 0.00 3 1.00 26 0.05 0 0 0 0
3 1.00 26 0.05 2 1.00 0 0 0 0
2 1.00 28 0.00 3 1.00 0 0 0 0
28 0.00 3 1.00 19 0.00 0 0 0 0
3 1.00 19 0.00 1 1.00 0 0 0 0
0 0.00 2 1.00 14 0.00 0 0 0 0
2 1.00 14 0.00 48 0.00 0 0 0 1
14 0.00 48 0.00 14 0.00 0 0 0 1
48 0.00 14 0.00 70 0.30 0 0 0 1
14 0.00 70 0.30 6 0.00 0 0 0 1
70 0.30 6 0.00 35 0.00 0 0 0 1
6 0.00 35 0.00 11 0.00 0 0 0 1
35 0.00 11 0.00 0 0.00 0 0 0 0
0 0.00 8 0.00 70 0.00 0 1 1 1
8 0.00 70 0.00 90 0.03 0 1 1 1
70 0.00 90 0.03 45 0.00 0 1 1 1
90 0.03 45 0.00 12 0.00 0 1 1 1
45 0.00 12 0.00 60 0.00 0 1 1 1
12 0.00 60 0.00 5 0.00 0 1 1 1
60 0.00 5 0.00 38 0.00 0 1 1 1
5 0.00 38 0.00 0 0.00 0 1 1 1
0 0.00 2 0.00 34 0.00 0 1 1 0
2 0.00 34 0.00 1 1.00 0 1 1 0
34 0.00 1 1.00 3 0.00 0 1 1 0
1 1.00 3 0.00 58 0.00 0 1 1 0
3 0.00 58 0.00 1 1.00 0 1 1 0
58 0.00 1 1.00 2 0.50 0 1 1 0
1 1.00 2 0.50 12 0.00 0 1 1 0
2 0.50 12 0.00 2 1.00 0 1 1 0
12 0.00 2 1.00 0 0.00 0 1 1 0
0 0.00 6 0.00 110 0.00 0 1 1 1
6 0.00 110 0.00 75 0.10 0 1 1 1
110 0.00 75 0.10 3 1.00 0 1 1 1
75 0.10 3 1.00 0 0.00 0 1 1 0
0 0.00 2 1.00 20 0.00 0 1 1 0
2 1.00 20 0.00 1 1.00 0 1 1 0
20 0.00 1 1.00 2 1.00 0 1 1 0
1 1.00 2 1.00 80 0.00 0 1 1 0
2 1.00 80 0.00 1 1.00 0 1 1 0
80 0.00 1 1.00 0 0.00 0 1 1 0
4 0.00 24 0.00 30 0.90 0 0 0 0
9 0.00 26 0.00 14 1.00 0 0 0 0
40 0.00 24 0.00 30 0.95 0 0 0 0
40 0.00 24 0.00 30 0.05 0 0 0 1
12 0.00 26 0.00 14 0.05 0 0 0 1
15 0.00 32 0.00 20 0.80 0 0 0 0
15 0.00 32 0.00 20 0.10 0 0 0 1
1 1.00 8 0.00 45 0.00 0 0 1 1
11 0.00 3 0.00 60 0.00 0 0 1 1
1 0.00 1 0.00 1 0.00 0 0 1 1
30 0.00 120 0.08 14 0.00 0 0 1 1
66 0.00 250 0.00 12 0.00 0 0 1 1
22 0.00 6 0.30 31 0.00 0 0 1 1
0 0.00 5 0.00 40 0.00 0 0 1 1
4 1.00 16 0.00 3 1.00 0 0 1 1
9 0.00 12 0.00 12 0.00 0 0 1 1
5 0.00 30 0.00 12 0.10 0 0 1 1
12 0.00 4 0.00 1 1.00 0 0 1 1
9 0.00 12 0.00 1 1.00 0 0 1 1
3 0.00 20 0.00 2 1.00 0 0 1 1
14 0.00 30 0.00 4 1.00 0 0 1 1
6 0.00 33 0.00 5 0.90 0 0 1 1
2 0.00 22 0.00 1 1.00 0 0 1 1
16 1.00 21 0.00 6 0.00 0 0 0 0
22 1.00 17 0.00 4 0.00 0 0 0 0
6 1.00 19 0.00 7 0.00 0 0 0 0
16 0.00 21 0.00 6 0.00 0 0 0 1
22 0.00 17 0.00 4 0.00 0 0 0 1
30 0.00 19 0.00 7 0.00 0 0 0 1
1 1.00 23 0.00 23 0.00 0 0 0 1
2 1.00 25 0.00 22 0.00 0 0 0 1
23 0.00 23 0.00 2 1.00 0 0 0 1
25 0.00 24 0.00 1 1.00 0 0 0 1
28 0.00 20 0.00 1 1.00 0 0 0 1
1 1.00 12 0.00 2 1.00 0 0 1 1
2 1.00 20 0.00 1 1.00 0 0 1 1
1 1.00 5 0.00 3 1.00 0 0 1 1
2 1.00 32 0.00 1 1.00 0 0 1 1
26 0.00 27 0.00 2 1.00 0 0 0 1
22 0.00 30 0.00 3 1.00 0 0 0 1
31 0.00 26 0.00 4 1.00 0 0 0 1
"""
