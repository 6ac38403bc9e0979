"""The candlestick patterns: (name, forecast, bar before, bars from the oldest, further condition)."""

# The templates. G, R: close not below, below the close before; hollow, filled: open below close, or not. W2+, B2+: full white, black candles; W3+, B3+: short ones as well; Doji4: every doji but the four-price one.
PATTERNS = (
    ("BearishBelthold", "BearishReversal", "", "filled line=LONG lower_wick_lt_body OpeningBlackMarubozu", "least(o1, c1) - l1 < 0.25000001 * abs(o1 - c1)"),
    ("BearishStrongLine", "BearishReversalOrContinuation", "", "filled line=LONG lower_wick_lt_body upper_wick_lt_body LongBlackCandle|BlackMarubozu|ClosingBlackMarubozu|OpeningBlackMarubozu", "abs(o1 - c1) > 3 * ema_body"),
    ("BullishBeltHold", "BullishReversal", "", "hollow line=LONG upper_wick_lt_body OpeningWhiteMarubozu", "h1 - greatest(o1, c1) < 0.25000001 * abs(o1 - c1)"),
    ("BullishStrongLine", "BullishReversalOrContinuation", "", "hollow line=LONG lower_wick_lt_body upper_wick_lt_body LongWhiteCandle|ClosingWhiteMarubozu|OpeningWhiteMarubozu|WhiteMarubozu", "abs(o1 - c1) > 3 * ema_body"),
    ("GappingDownDoji", "BearishContinuation", "!FourPriceDoji", "Doji4 wick_gap=DOWN", ""),
    ("GappingUpDoji", "BullishContinuation", "!FourPriceDoji", "Doji4 wick_gap=UP", ""),
    ("Hammer", "BullishReversal", "", "BlackSpinningTop|WhiteSpinningTop line=LONG upper_wick_lt_body NOT_lower_wick_lt_body lower_wick_2x", ""),
    ("HangingMan", "BearishReversal", "", "body=SHORT line=LONG upper_wick_lt_body NOT_lower_wick_lt_body !Doji", "ema < o1 and ema < c1"),
    ("NorthernDoji", "BearishReversal", "", "G Doji4 body_gap=UP", "l1 >= ema"),
    ("OneCandleShootingStar", "BearishReversal", "", "body=SHORT body_gap=UP lower_wick_lt_body upper_wick_2x BlackSpinningTop|HighWave|WhiteSpinningTop", ""),
    ("SouthernDoji", "BullishReversal", "", "R Doji4 body_gap=DOWN", "h1 <= ema"),
    ("TakuriLine", "BullishReversal", "", "body=SHORT line=LONG upper_wick_lt_body lower_wick_2x !Doji", "least(o1, c1) - l1 >= 3 * abs(o1 - c1) and o1 < ema and c1 < ema"),
    ("BearishDojiStar", "BearishReversal", "", "hollow G line=LONG body=LONG W2+; G Doji4 body_gap=UP", ""),
    ("BearishEngulfing", "BearishReversal", "", "hollow !FourPriceDoji; R filled line=LONG B2+ engulf_prev=BODY", ""),
    ("BearishHarami", "BearishReversal", "", "G hollow line=LONG W2+; R filled !FourPriceDoji inside_prev=BODY", ""),
    ("BearishHaramiCross", "BearishReversal", "", "G hollow line=LONG W2+; R Doji|LongLeggedDoji inside_prev=LINE", ""),
    ("BearishMeetingLines", "BearishReversal", "", "G hollow line=LONG body=LONG W2+; G filled body=LONG line=LONG close_in_prev_body close_above_prev_mid B2+", "c1 = c2"),
    ("BearishSeparatingLines", "BearishContinuation", "", "hollow line=LONG body=LONG W2+; R filled line=LONG body=LONG open_in_prev_body NOT_open_above_prev_mid B2+", "o1 = o2"),
    ("BearishTasukiLine", "BearishReversal", "", "G hollow line=LONG low_in_prev_line W2+; R filled line=LONG body=LONG open_in_prev_body NOT_close_in_prev_body NOT_close_above_prev_mid B2+", ""),
    ("BullishDojiStar", "BullishReversal", "", "filled R line=LONG body=LONG B2+; R Doji4 body_gap=DOWN", ""),
    ("BullishEngulfing", "BullishReversal", "", "filled !FourPriceDoji; G hollow line=LONG W2+ engulf_prev=BODY", ""),
    ("BullishHarami", "BullishReversal", "", "R filled line=LONG B2+; G hollow !FourPriceDoji inside_prev=BODY", "l1 <> l2 and not (_type in ('Doji', 'LongLeggedDoji', 'DragonflyDoji', 'GravestoneDoji', 'FourPriceDoji') and h2 between least(o1, c1) and greatest(o1, c1) and l2 between least(o1, c1) and greatest(o1, c1))"),
    ("BullishHaramiCross", "BullishReversal", "", "R filled line=LONG B2+; G Doji|LongLeggedDoji inside_prev=LINE", ""),
    ("BullishMeetingLines", "BullishReversal", "", "R filled line=LONG body=LONG B2+; G hollow close_in_prev_body NOT_close_above_prev_mid line=LONG body=LONG W2+", "c1 = c2"),
    ("BullishSeparatingLines", "BullishContinuation", "", "filled line=LONG body=LONG B2+; G hollow line=LONG body=LONG open_in_prev_body open_above_prev_mid W2+", "o1 = o2"),
    ("BullishTasukiLine", "BullishReversal", "", "R filled line=LONG high_in_prev_line B2+; G hollow line=LONG body=LONG open_in_prev_body NOT_close_in_prev_body close_above_prev_mid W2+", ""),
    ("DarkCloudCover", "BearishReversal", "", "G hollow line=LONG body=LONG W2+; R filled line=LONG body=LONG NOT_open_in_prev_body open_above_prev_mid close_in_prev_body NOT_close_above_prev_mid B2+", ""),
    ("DescendingHawk", "BearishReversal", "", "G hollow line=LONG W2+; R hollow W3+ inside_prev=BODY", ""),
    ("FallingWindow", "BearishContinuation", "", "!FourPriceDoji; wick_gap=DOWN R !FourPriceDoji", "c1 < ema"),
    ("HomingPigeon", "BullishReversal", "", "R filled line=LONG B2+; G filled B3+ inside_prev=BODY", ""),
    ("InNeck", "BearishContinuation", "", "filled line=LONG body=LONG B2+; G hollow NOT_lower_wick_2x NOT_upper_wick_2x NOT_open_in_prev_body NOT_open_above_prev_mid close_in_prev_body NOT_close_above_prev_mid !Doji", "(c2 - least(o1, c1)) / nullif(abs(o1 - c1), 0) * 100 <= 15"),
    ("InvertedHammer", "BullishReversal", "", "filled line=LONG body=LONG B2+; body=SHORT lower_wick_lt_body upper_wick_2x NOT_open_above_prev_mid BlackSpinningTop|HighWave|WhiteSpinningTop", "o2 <= c1"),
    ("KickingDown", "BearishReversalOrContinuation", "", "hollow line=LONG body=LONG WhiteMarubozu; R wick_gap=DOWN body=LONG filled line=LONG BlackMarubozu", ""),
    ("KickingUp", "BullishReversalOrContinuation", "", "filled line=LONG body=LONG BlackMarubozu; G wick_gap=UP hollow line=LONG body=LONG WhiteMarubozu", ""),
    ("MatchingHigh", "BearishReversal", "", "hollow line=LONG ClosingWhiteMarubozu|WhiteMarubozu; inside_prev=BODY G hollow ClosingWhiteMarubozu|WhiteMarubozu", "c1 = c2"),
    ("MatchingLow", "BullishReversal", "", "filled line=LONG BlackMarubozu|ClosingBlackMarubozu; inside_prev=BODY G filled BlackMarubozu|ClosingBlackMarubozu", "c1 = c2"),
    ("OnNeck", "BearishContinuation", "", "filled line=LONG body=LONG B2+; body_gap=DOWN R hollow NOT_lower_wick_2x NOT_upper_wick_2x !Doji", "c2 = l1"),
    ("Piercing", "BullishReversal", "", "R filled line=LONG body=LONG B2+; G hollow line=LONG body=LONG NOT_low_in_prev_line NOT_open_in_prev_body NOT_open_above_prev_mid close_in_prev_body close_above_prev_mid W2+", ""),
    ("RisingWindow", "BullishContinuation", "", "!FourPriceDoji; wick_gap=UP G !FourPriceDoji", "c1 > ema"),
    ("Thrusting", "BearishContinuation", "", "R filled line=LONG body=LONG B2+; G hollow line=LONG NOT_open_in_prev_body NOT_open_above_prev_mid close_in_prev_body NOT_close_above_prev_mid W2+", ""),
    ("TurnDown", "BearishReversal", "", "!FourPriceDoji hollow; filled body_gap=DOWN R !FourPriceDoji", "l1 < ema and ema < o1 and o2 < ema"),
    ("TurnUp", "BullishReversal", "", "!FourPriceDoji filled; hollow body_gap=UP G !FourPriceDoji", "o1 < ema and ema < h1 and o2 > ema"),
    ("TweezersBottom", "BullishReversal", "", "!FourPriceDoji; !FourPriceDoji inside_prev=LINE", "l1 = l2"),
    ("TweezersTop", "BearishReversal", "", "!FourPriceDoji !ClosingWhiteMarubozu|WhiteMarubozu; !FourPriceDoji !ClosingWhiteMarubozu|WhiteMarubozu inside_prev=LINE", "h1 = h2"),
    ("TwoBlackGappingCandles", "BearishContinuation", "", "filled R body_gap=DOWN NOT_lower_wick_2x NOT_upper_wick_2x !Doji !HighWave; filled R NOT_lower_wick_2x NOT_upper_wick_2x open_in_prev_body NOT_close_in_prev_body NOT_close_above_prev_mid !Doji !HighWave", ""),
    ("TwoCandleShootingStar", "BearishReversal", "", "G hollow line=LONG W2+; G body=SHORT body_gap=UP NOT_upper_wick_lt_body upper_wick_2x lower_wick_lt_body BlackSpinningTop|HighWave|WhiteSpinningTop", "h2 - greatest(o2, c2) >= 2.5 * abs(o2 - c2)"),
    ("AdvanceBlock", "BearishReversal", "", "G hollow line=LONG W2+; G hollow open_in_prev_body NOT_close_in_prev_body close_above_prev_mid NOT_body_gt_prev_body; G hollow open_in_prev_body NOT_close_in_prev_body close_above_prev_mid NOT_body_gt_prev_body", "(h2 - l2 - abs(o2 - c2)) > (h1 - l1 - abs(o1 - c1)) and (h3 - l3 - abs(o3 - c3)) > (h1 - l1 - abs(o1 - c1))"),
    ("BearishAbandonedBaby", "BearishReversal", "", "G hollow line=LONG body=LONG W2+; G Doji4 wick_gap=UP; R filled line=LONG body=LONG B2+ wick_gap=DOWN", ""),
    ("BearishTriStar", "BearishReversal", "", "G body_gap=UP Doji4; G body_gap=UP Doji4; R body_gap=DOWN Doji4", ""),
    ("BearSideBySideWhiteLines", "BearishContinuation", "", "R filled line=LONG body=LONG B2+; R hollow wick_gap=DOWN W3+; hollow W3+", "abs(o2 - c2) <= abs(o1 - c1) and abs(o3 - c3) <= abs(o1 - c1) and l1 > h3 and abs(c2 - c3) <= 0.05 * ema_line and abs(o2 - o3) <= 0.05 * ema_line"),
    ("BullAbandonedBaby", "BullishReversal", "", "R filled line=LONG body=LONG B2+; R Doji4 wick_gap=DOWN; G hollow line=LONG body=LONG W2+ wick_gap=UP", ""),
    ("BullishTriStar", "BullishReversal", "", "R body_gap=DOWN Doji4; R body_gap=DOWN Doji4; G body_gap=UP Doji4", ""),
    ("BullSidebySideWhiteLines", "BullishContinuation", "", "G hollow line=LONG body=LONG W2+; G hollow W3+ wick_gap=UP; hollow W3+", "abs(o2 - c2) <= abs(o1 - c1) and abs(o3 - c3) <= abs(o1 - c1) and h1 < l3 and abs(c2 - c3) <= 0.05 * ema_line and abs(o2 - o3) <= 0.05 * ema_line"),
    ("Collapsingdojistar", "BearishReversal", "", "hollow !Doji; R Doji4 wick_gap=DOWN; R filled !Doji wick_gap=DOWN", ""),
    ("Deliberation", "BearishReversal", "", "G hollow body=LONG; G hollow body=LONG open_in_prev_body NOT_close_in_prev_body close_above_prev_mid; G hollow line=SHORT low_in_prev_line NOT_close_in_prev_body close_above_prev_mid NOT_body_gt_prev_body ShortWhiteCandle|WhiteSpinningTop", "abs(o3 - c3) <= abs(o1 - c1)"),
    ("DownsideGapThreemethods", "BearishContinuation", "", "R filled line=LONG body=LONG B2+; R filled wick_gap=DOWN line=LONG body=LONG B2+; G hollow open_in_prev_body NOT_close_in_prev_body close_above_prev_mid W3+", "c3 between least(o1, c1) and greatest(o1, c1)"),
    ("DownsideTasukiGap", "BearishContinuation", "", "R filled line=LONG body=LONG B2+; R filled wick_gap=DOWN B3+; G hollow open_in_prev_body NOT_close_in_prev_body !Doji", "c3 < c1"),
    ("EveningDojiStar", "BearishReversal", "", "G hollow line=LONG body=LONG W2+; G body_gap=UP Doji4; R filled body_gap=DOWN line=LONG body=LONG B2+", "(c3 - least(o1, c1)) / nullif(abs(o1 - c1), 0) * 100 < 50"),
    ("EveningStar", "BearishReversal", "", "G hollow line=LONG body=LONG W2+; G body_gap=UP body=SHORT !Doji; R filled body_gap=DOWN line=LONG body=LONG B2+", "(c3 - least(o1, c1)) / nullif(abs(o1 - c1), 0) * 100 < 50"),
    ("IdenticalThreeCrows", "BearishReversal", "", "R filled line=LONG body=LONG B2+; R filled line=LONG body=LONG B2+; R filled line=LONG body=LONG B2+", "(o2 - least(o1, c1)) / nullif(abs(o1 - c1), 0) * 100 between -5 and 5 and (o3 - least(o2, c2)) / nullif(abs(o2 - c2), 0) * 100 between -5 and 5"),
    ("MorningDojiStar", "BullishReversal", "", "R filled line=LONG body=LONG B2+; R body_gap=DOWN Doji4; G hollow body_gap=UP line=LONG body=LONG W2+", "(c3 - least(o1, c1)) / nullif(abs(o1 - c1), 0) * 100 > 50"),
    ("MorningStar", "BullishReversal", "", "R filled line=LONG body=LONG B2+; R body_gap=DOWN line=SHORT !Doji; G hollow body_gap=UP line=LONG body=LONG WhiteCandle|ClosingWhiteMarubozu|OpeningWhiteMarubozu|WhiteMarubozu", "(c3 - least(o1, c1)) / nullif(abs(o1 - c1), 0) * 100 > 50"),
    ("ThreeBlackCrows", "BearishReversal", "", "R filled line=LONG body=LONG B2+; R filled line=LONG body=LONG open_in_prev_body B2+; R filled line=LONG body=LONG open_in_prev_body B2+", ""),
    ("ThreeInsideDown", "BearishReversal", "", "G hollow line=LONG body=LONG W2+; R filled !Doji inside_prev=BODY; R filled !Doji", ""),
    ("ThreeInsideUp", "BullishReversal", "", "R filled line=LONG body=LONG B2+; G hollow !Doji inside_prev=BODY; G hollow !Doji", ""),
    ("ThreeOutsideDown", "BearishReversal", "", "G hollow !FourPriceDoji; R filled line=LONG body=LONG B2+ engulf_prev=BODY; R filled", ""),
    ("ThreeOutsideUp", "BullishReversal", "", "R filled !FourPriceDoji; G hollow line=LONG body=LONG W2+ engulf_prev=BODY; G hollow", ""),
    ("ThreeStarsInTheSouth", "BullishReversal", "", "R filled line=LONG NOT_lower_wick_lt_body; R filled open_in_prev_body low_in_prev_line !Doji; filled line=SHORT inside_prev=LINE BlackMarubozu|ClosingBlackMarubozu|OpeningBlackMarubozu", ""),
    ("ThreeWhiteSoldiers", "BullishReversal", "", "hollow line=LONG body=LONG W2+; G hollow line=LONG body=LONG open_in_prev_body W2+; G hollow line=LONG body=LONG open_in_prev_body W2+", ""),
    ("TwoCrows", "BearishReversal", "", "G hollow line=LONG body=LONG W2+; G filled !Doji body_gap=UP; R filled line=LONG body=LONG open_in_prev_body B2+", "c3 between least(o1, c1) and greatest(o1, c1)"),
    ("UniqueThreeRiverBottom", "BullishReversal", "", "R line=LONG body=LONG B2+; G filled line=LONG inside_prev=BODY lower_wick_2x NOT_low_in_prev_line; R hollow line=SHORT body_gap=DOWN low_in_prev_line", ""),
    ("UpsideGapThreeMethods", "BullishContinuation", "", "G hollow line=LONG body=LONG W2+; G hollow wick_gap=UP line=LONG body=LONG W2+; R filled open_in_prev_body NOT_close_in_prev_body NOT_close_above_prev_mid B3+", "c3 between least(o1, c1) and greatest(o1, c1)"),
    ("UpsideGapTwoCrows", "BearishReversal", "", "G hollow line=LONG body=LONG W2+; G filled body_gap=UP !Doji; R filled B2+ engulf_prev=BODY body=LONG", "c3 > c1"),
    ("UpsideTasukiGap", "BullishContinuation", "", "G hollow line=LONG body=LONG W2+; G hollow wick_gap=UP W3+; R filled open_in_prev_body NOT_close_in_prev_body !Doji", "c3 > c1"),
    ("BearishThreeLineStrike", "BearishContinuation", "", "R filled !Doji; R filled open_in_prev_body !Doji; R filled open_in_prev_body !Doji; G hollow line=LONG body=LONG engulf_prev=BODY W2+", "greatest(o4, c4) >= greatest(o1, c2) and least(o4, c4) <= least(o1, c2)"),
    ("BullishThreeLineStrike", "BullishContinuation", "", "G hollow !Doji; G hollow open_in_prev_body !Doji; G hollow open_in_prev_body !Doji; R line=LONG body=LONG engulf_prev=BODY B2+", "greatest(o4, c4) >= greatest(o1, c2) and least(o4, c4) <= least(o1, c2)"),
    ("ConcealingBabySwallow", "BullishReversal", "", "R BlackMarubozu; R open_in_prev_body body=LONG BlackMarubozu; R body_gap=DOWN high_in_prev_body lower_wick_lt_body HighWave; line=LONG body=LONG B2+ engulf_prev=LINE", "l3 = c3"),
)
