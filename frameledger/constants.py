"""Fixed values. They must equal the published ones for results to be right."""

# The ten class folders, in label order (label = position).
GESTURES = (
    "G01_call", "G02_dislike", "G03_like", "G04_ok", "G05_one",
    "G06_palm", "G07_peace", "G08_rock", "G09_stop", "G10_three",
)
N_CLASSES = 10

# File-name patterns.
FRAME_PATTERN = r"(?i)^frame_(\d+)\.(png|jpg|jpeg)$"
CLIP_NAME_PATTERN = r"(?i)^(G\d{2}_[A-Za-z]+)_?(clip\d{2})\.(mp4|mov|m4v|avi)$"
SCENE_NAME_PATTERN = r"(?i)^G(\d{1,2})_([A-Za-z]+)\.(mp4|mov|m4v|avi)$"

# Mask and score thresholds.
MASK_THRESHOLD = 128
DETECTION_THRESHOLDS = (0.5, 0.75, 0.9)
CALIBRATION_BINS = 15
EPS_AREA = 1e-7
DET_STRIDE = 4

# Reference bands used to flag a mask.
AREA_LO, AREA_HI = 0.010, 0.075
ASPECT_LO, ASPECT_HI = 0.35, 1.60
CENTRE_LO, CENTRE_HI = 0.15, 0.85
MIN_FILL = 0.30
MIN_COMPONENT = 0.005
AREA_PCT_P05, AREA_PCT_P95 = 1.59, 4.73
PRIOR_CENTRE = (0.45, 0.49)
LANDMARK_PAD = 0.12

# Frame picking: held portion of a clip and stride.
HOLD_LO, HOLD_HI, PICK_STRIDE = 0.20, 0.80, 3

# Luma weights of the saturation and hue matrices, and the hue constants.
LUM_R, LUM_G, LUM_B = 0.213, 0.715, 0.072
HUE_GR, HUE_GG, HUE_GB = 0.143, 0.140, -0.283

# Held-out shift: tone knots, unsharp amount, sigma and radius, saturation.
SHIFT_TONE_X = (0.00, 0.10, 0.25, 0.50, 0.75, 0.90, 1.00)
SHIFT_TONE_Y = (0.00, 0.030, 0.110, 0.500, 0.890, 0.970, 1.00)
SHIFT_AMOUNT, SHIFT_SIGMA, SHIFT_RADIUS, SHIFT_SATURATION = 1.5, 1.2, 3, 1.4

# Skin-chroma bands: (Cr low, Cr high, Cb low, Cb high).
SKIN_TIGHT = (133, 173, 77, 127)
SKIN_LOOSE = (130, 180, 77, 135)

# Channel statistics of the image normalisation.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

# Metrics a run without the given head cannot produce.
HEAD_METRICS = {
    "det": ("det_acc50", "det_acc75", "mean_box_iou"),
    "seg": ("seg_iou_hand", "seg_miou", "seg_dice"),
}

# Photometric modes and stages of the colour job.
PHOTOMETRIC_MODES = ("none", "jitter", "cpr", "randconv", "augmix")
CAMERA_STAGES = (
    "wb", "exposure", "ccm", "noise", "gamma", "tone",
    "satihue", "sharpblur", "resample", "chroma",
)

FILE_METRIC_NAMES = {"det_acc50": "det_acc@0.5", "det_acc75": "det_acc@0.75", "det_acc90": "det_acc@0.9"}
