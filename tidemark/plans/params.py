"""Parameters of the scoring model. They have to equal the published ones for equal results."""

BIAS = -1.25
#: feature: (weight, neutral value)
FEATURES = {
    "source_risk": (2.20, 0.0),
    "light_corr_face": (-2.40, 0.50),
    "light_lag_ms": (0.005, 50.0),
    "light_neck_face_ratio": (-0.80, 0.80),
    "light_neck_face_corr": (-1.50, 0.75),
    "light_snr": (-0.15, 3.0),
    "edge_logit": (1.45, 0.0),
    "clip_logit": (1.65, 0.0),
    "model_disagreement": (0.40, 0.0),
    "ood_score": (0.35, 0.0),
    "identity_flicker": (1.80, 0.0),
    "landmark_jitter": (1.20, 0.0),
    "occlusion_artifact": (1.10, 0.0),
    "spoof_max": (2.05, 0.0),
    "spoof_mean": (1.15, 0.0),
    "sync_conf": (-0.45, 2.0),
    "sync_offset_ms": (0.004, 0.0),
    "phrase_wer": (1.95, 0.0),
    "bilabial_aperture_err": (2.60, 0.0),
    "quality_trust": (-0.70, 0.85),
    "replay_score": (2.40, 0.0),
    "screen_glare": (1.60, 0.0),
    "reflection_decoupling": (1.50, 0.0),
    "static_face_risk": (2.50, 0.0),
}
#: Features whose weight shrinks when the picture can't be trusted.
DAMPENED = ("edge_logit", "clip_logit", "identity_flicker", "landmark_jitter")
TRUST_FULL, DAMPEN_LEAST = 0.50, 0.35
#: logit, probability
KNOTS = [(-4.0, 0.02), (-2.5, 0.05), (-1.5, 0.12), (-0.8, 0.22), (-0.2, 0.32), (0.0, 0.38), (0.4, 0.48), (0.8, 0.60), (1.2, 0.72), (1.8, 0.84), (2.5, 0.92), (4.0, 0.98)]
ALPHA = 0.50
ENTER, ENTER_AFTER = 0.70, 2
LEAVE, LEAVE_AFTER = 0.60, 3
SUSPICIOUS = 0.40
GATE_RISK, GATE_LIGHT, GATE_FLOOR = 0.70, 0.20, 0.85
REARM_SEC = 15.0
LIKELY, DOUBTFUL, GENUINE = "Likely deepfake", "Suspicious", "Authentic"

CAMERA_KEYWORDS = ["obs", "virtual", "manycam", "droidcam", "epoccam", "xsplit", "snap camera", "vysor", "iriun", "camo", "fake", "capture device"]
TOO_SMOOTH_STD_MS, DROP_FACTOR, DROP_HIGH, LEAST_INTERVALS = 0.30, 2.2, 0.35, 10
PHRASE_WER_HIGH, APERTURE_MOST, APERTURE_BAND_SEC = 0.40, 0.12, 0.12
OFFSET_MOST_MS, SYNC_CONF_LEAST = 200.0, 1.5
LIGHT_CORR_LEAST, NECK_CORR_LEAST, LATE_LAG_MS, LAG_FRAMES = 0.35, 0.30, 120.0, 5
FPS, SAMPLE_RATE = 15, 16000
WINDOW_FRAMES, STRIDE_FRAMES, SAMPLED_FRAMES, RETAINED_FRAMES = 45, 15, 16, 75
#: Windows that wait for the consumer at most; the oldest goes when another comes.
QUEUE_CAPACITY = 2
MAX_MESSAGE, MAX_UPLOAD, MAX_SESSIONS, MAX_SESSION_SEC, SESSION_TTL_SEC = 2 << 20, 50 << 20, 4, 600, 300
LATENCY_BUCKETS = {"fast": [0.05, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0], "slow": [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 5.0]}

TITLES = {
    ("source", "replay", "high"): "Mobile Screen Replay Detected",
    ("source", "replay", "medium"): "Screen Glass Reflection Glare",
    ("source", "camera", "high"): "Virtual Camera Stream Detected",
    ("source", "camera", "medium"): "Suspicious Video Source Timing",
    ("light", "", "high"): "Failed Active Light Challenge",
    ("light", "", "medium"): "Weak Active Light Modulation",
    ("face", "artifacts", "high"): "Deepfake Boundary Artifacts",
    ("face", "artifacts", "medium"): "Facial Instability Detected",
    ("face", "static", "high"): "Static 2D Photo Attack Detected",
    ("face", "static", "medium"): "Low Facial Dynamics Warning",
    ("voice", "", "high"): "Synthetic Audio Cloned Voice",
    ("voice", "", "medium"): "Acoustic Spectral Anomaly",
    ("lips", "", "high"): "Phoneme-Lip Incoherence",
    ("lips", "", "medium"): "Mouth Motion Desynchronization",
}
#: What is said of a module's finding, by title.
DETAILS = {
    "Virtual Camera Stream Detected": "Software capture device or synthetic frame timing signature identified.",
    "Suspicious Video Source Timing": "Frame delivery jitter deviates from physical webcam hardware behavior.",
    "Mobile Screen Replay Detected": "Specular glass reflections, motion decoupling, and display artifacts indicate a video replay on a mobile screen to the webcam.",
    "Screen Glass Reflection Glare": "Planar specular reflection highlights and subpixel artifacts observed over facial region.",
    "Failed Active Light Challenge": "Skin luminance did not modulate in sync with the randomized challenge sequence.",
    "Weak Active Light Modulation": "Low photometric correlation between challenge sequence and face reflection.",
    "Synthetic Audio Cloned Voice": "Acoustic features display non-natural vocoder synthesis patterns.",
    "Acoustic Spectral Anomaly": "Voice harmonics indicate potential voice conversion or re-synthesis.",
    "Deepfake Boundary Artifacts": "High-frequency frequency-domain blending seams and temporal embedding flicker detected.",
    "Facial Instability Detected": "Micro-jitter and spatial blending boundaries observed across consecutive frames.",
    "Facial Landmark Jitter Anomaly": "Unnatural high-frequency motion jitter detected across facial keypoints.",
    "Occlusion Reconstruction Seams": "Facial boundary degradation observed during hand/object occlusion.",
    "Rigid 2D Photo Motion Detected": "The face moves as a flat rigid plane with zero internal facial deformation. Consistent with a printed photo being moved.",
    "Static 2D Photo Attack Detected": "Zero biological motion, eye blinking, or micro-expression detected across video frames. Facial features are static.",
    "Phoneme-Lip Incoherence": "Failure to seal lips on bilabial consonants (B/P/M) with significant AV desync.",
    "Mouth Motion Desynchronization": "Aperture anomalies during bilabial speech segments.",
}
ACTIONS = {
    "latch": "Ask the caller to turn their head left, then say the phrase again.",
    "camera": "Hard gate triggered: Virtual camera with light modulation failure. Escalate for manual review.",
    "replay": "Mobile screen replay detected via physical display artifacts. Escalate for manual review.",
    "static": "Static 2D photo attack detected: Lack of biological facial motion. Prompt caller to blink or turn head.",
}
ADVICE = {
    LIKELY: "Recommendation: Escalate for manual analyst review or issue a secondary physical head-turn challenge.",
    DOUBTFUL: "Recommendation: Request additional caller verbal verification before proceeding with authentication.",
    GENUINE: "Recommendation: Biometric and hardware checks confirm legitimate caller presence.",
}
NO_FINDINGS = "All evaluated biometric and physical challenge signals remained within expected authentic baselines."
